"""Operator 13: importance resampling towards a target distribution, with segment deduplication.

Features are runs of 1 to ``n`` consecutive words, hashed into ``buckets``.  A
bucket's gain is the logarithm of its share in the target texts over its share
in all documents; a document's weight is the mean gain of its features, and a
Gumbel draw by the id's digest turns weights into a sample without replacement
of ``percent`` of the documents.

Texts repeat lines far more often than they repeat as a whole, and a line break
always parts words.  So texts are cut into lines, a line's buckets are computed
once for all its occurrences: the corpus counts are the counts of the distinct
lines times their occurrences, and a document's gain is the sum over its lines
of the line's gain.  Runs of words that cross a line break belong to no line and
are added for each document (there are none for ``n`` = 1).

A line travels once with its text, to the distinct lines, and from then on as its
SHA-256; a very common line is combined per task and per document first, and
adaptive execution splits its rows in the join.  The table of gains has
``buckets`` rows at most and is the only thing that the driver or all tasks
hold.  The drawn documents are numbered by a range sort
(:mod:`revlens.llm.ranks`).

Defined cases: null and empty texts have no features and weight 0; a null id is
hashed as an empty one; rows with equal ids count each, ties of score and id are
ranked in any order; null texts of the target are left out; with an empty
target all gains follow the same formula; an empty table gives an empty result;
further columns are ignored, names may clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, cut, slices
from revlens.llm.ranks import positions

# fixed value: the reflected polynomial of CRC-32
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = (_TABLE >> np.uint32(1)) ^ np.where(_TABLE & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


def _append(crc: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Take the bytes [start, end) into each running CRC, in place: one step for each byte position."""
    order = np.argsort(start - end, kind="stable")           # longest first
    state, begin, size = crc[order], start[order], (end - start)[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        now = state[:n]
        state[:n] = (now >> np.uint32(8)) ^ _TABLE[(now ^ body[begin[:n] + k]) & np.uint32(255)]
    crc[order] = state


def run_buckets(body: np.ndarray, off: np.ndarray, n: int, buckets: int,
                crossing: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all runs of 1 to n words, first run of each text, words of each text) of a slice of texts.

    With ``crossing`` only runs whose first and last word are parted by a line break count.
    """
    body = H.lower_ascii(body)
    w = H.split_words(body, off, letters=True)
    stop = w.first[1:][w.doc]                                # after the last word of the word's text
    line = np.searchsorted(np.flatnonzero(body == 10), w.start)
    crc, found, of = np.full(len(w.start), 0xFFFFFFFF, np.uint32), [], []
    place = np.arange(len(w.start))
    for size in range(1, n + 1):
        if size > 1:
            keep = place + size <= stop[place]
            crc, place = crc[keep], place[keep]
            crc = (crc >> np.uint32(8)) ^ _TABLE[(crc ^ np.uint32(32)) & np.uint32(255)]
        last = place + size - 1
        _append(crc, body, w.start[last], w.end[last])
        keep = line[place] != line[last] if crossing else slice(None)
        found.append(((~crc) % np.uint32(buckets))[keep])
        of.append(w.doc[place][keep])
    doc, bucket = np.concatenate(of), np.concatenate(found).astype(np.int32)
    if n > 1:
        order = np.argsort(doc, kind="stable")
        doc, bucket = doc[order], bucket[order]
    return bucket, np.searchsorted(doc, np.arange(len(off))), np.diff(w.first)


def _line_rows(n: int, buckets: int):
    """Rows (line, occurrences) to (digest, occurrences, n_words, buckets)."""
    def run(batches):
        for batch in batches:
            for a, b, body, off in slices(batch.column(0)):
                bucket, first, words = run_buckets(body, off, n, buckets)
                text = body.tobytes()
                digests = [hashlib.sha256(text[i:j]).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), batch.column(1).slice(a, b - a), pa.array(words.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bucket))],
                    ["digest", "occurrences", "n_words", "buckets"])

    return run


def _crossing_rows(n: int, buckets: int):
    """Rows (row, id, digests, text) to (row, id, digests, buckets of the runs that cross a line break)."""
    def run(batches):
        for batch in batches:
            for a, b, body, off in slices(batch.column(3)):
                bucket, first, _ = run_buckets(body, off, n, buckets, crossing=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(3)]
                    + [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(bucket))], ["row", "id", "digests", "buckets"])

    return run


def segment(texts: DataFrame, n: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(rows, lines) of a table (id, text) without nulls in text.

    rows: (row, id, digests of the lines, buckets of the crossing runs);
    lines: (digest, occurrences, n_words, buckets), one row for each distinct line that holds words.
    """
    split = F.split("text", "\n", -1)
    lines = (texts.select(F.explode(split).alias("line")).where("line <> ''")
             .groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
             .mapInArrow(_line_rows(n, buckets), "digest binary, occurrences long, n_words long, buckets array<int>")
             .where("n_words > 0"))
    digests = F.transform(F.filter(split, lambda s: s != ""), lambda s: F.unhex(F.sha2(s, 256)))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "id", digests.alias("digests"), "text")
    if n == 1:
        return rows.select("row", "id", "digests", F.array().cast("array<int>").alias("buckets")), lines
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_crossing_rows(n, buckets), f"row long, id {kind}, digests array<binary>, buckets array<int>"), lines


def bucket_counts(rows: DataFrame, lines: DataFrame) -> dict[int, int]:
    """Features of all texts by bucket: those of distinct lines times their occurrences, and the crossing ones."""
    found = (lines.select(F.explode("buckets").alias("bucket"), "occurrences")
             .unionByName(rows.select(F.explode("buckets").alias("bucket"), F.lit(1).cast("long").alias("occurrences")))
             .groupBy("bucket").agg(F.sum("occurrences").alias("n")))
    return {r.bucket: r.n for r in found.collect()}  # at most ``buckets`` rows


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed corpus share)) of each bucket, in doubles."""
    total, wanted = float(sum(corpus.values())), float(sum(target.values()))
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (total + buckets)
                                                / ((corpus.get(b, 0) + 1.0) * (wanted + buckets))))
                     for b in range(buckets)], np.int64)


def _with_gain(df: DataFrame, gain: np.ndarray) -> DataFrame:
    """``buckets`` replaced by (n, gain): the number of features and the sum of their gains."""
    at = df.columns.index("buckets")
    kept = [f for f in df.schema.fields if f.name != "buckets"]

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            offsets = np.asarray(lists.offsets, np.int64)
            total = np.zeros(len(lists.values) + 1, np.int64)
            np.cumsum(gain[np.asarray(lists.values)], out=total[1:])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets]))],
                                             [f.name for f in kept] + ["n", "gain"])

    from pyspark.sql.types import LongType, StructField, StructType
    return df.mapInArrow(run, StructType([*kept, StructField("n", LongType()), StructField("gain", LongType())]))


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
          n: int = 1, buckets: int = 10000) -> DataFrame:
    """One row per document: (id, n_words, n_features, weight)."""
    bound_batches(docs.sparkSession)
    rows, lines = segment(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")),
                          n, buckets)
    rows, lines = cut(rows), cut(lines)
    wanted = segment(target.select(F.lit(0).alias("id"), F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("text")),
                     n, buckets)
    gain = gains(bucket_counts(rows, lines), bucket_counts(*wanted), buckets)
    per_line = _with_gain(lines.select("digest", "n_words", "buckets"), gain)
    held = (rows.select("row", F.explode("digests").alias("digest")).groupBy("row", "digest")
            .agg(F.count(F.lit(1)).alias("times")))
    inside = (held.join(per_line, "digest").groupBy("row")
              .agg(*[F.sum(F.col(c) * F.col("times")).alias(f"in_{c}") for c in ("n_words", "n", "gain")]))
    across = rows.select("row", "id", "buckets")
    across = _with_gain(across, gain) if n > 1 else across.select("row", "id", F.lit(0).alias("n"), F.lit(0).alias("gain"))
    number = {c: F.coalesce(F.col(f"in_{c}"), F.lit(0)) for c in ("n_words", "n", "gain")}
    total = across.join(inside, "row", "left").select(
        "id", number["n_words"].alias("n_words"), (F.col("n") + number["n"]).cast("long").alias("n_features"),
        (F.col("gain") + number["gain"]).cast("long").alias("gain"))
    return total.select("id", "n_words", "n_features", F.expr(
        "case when n_features = 0 then 0L else (gain - pmod(gain, n_features)) div n_features end").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
             n: int = 1, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per document: (doc_id, n_words, n_features, weight, score, rank); rank is null where it is not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred (rounded down) are drawn: those with
    the highest scores, ties to the smaller id.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = (weigh(docs, target, text_col, id_col, target_col, n, buckets)
              .withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("short", F.col("n_words") < least_words))
    # those that can be drawn come first, the best of them foremost
    placed = positions(scored, [], ["short", F.col("score").desc(), F.col("id").asc_nulls_last()])
    usable = placed.where("not short").agg(F.count(F.lit(1)).alias("n"))
    drawn = usable.first().n * percent // 100
    rank = F.when(~F.col("short") & (F.col("pos") < drawn), F.col("pos") + 1)
    return placed.select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", rank.alias("rank"))
