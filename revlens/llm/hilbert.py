"""Operator 6: sharding along a Hilbert curve.

Several metadata columns are quantised to ``2 ** bits`` steps each, at the
quantiles of the data (texts compared whole); a value that holds several
quantiles takes their middle, so a column of few values uses all levels of the
curve.  A row's steps give its index on a Hilbert curve.  Rows sorted by that
index are cut into runs of equal counts (law ``rows``: counts differ by one at
most), so each shard covers a compact region and its files can be pruned by any
of the columns.  Rows of equal texts take the smallest index among them and stay
together; only a group in which a cut falls lies in more than one shard.

The sort is a range partition on (index, text digest, id): a group of rows
with one index is split among tasks by its ids.  Positions are the counts of
the partitions before a row's own (one number for each partition) plus its
place inside it.

Defined cases: a null text has no bytes and the checksum of an empty text; null
metadata takes the lowest step; null ids sort first; repeated rows take one
slot each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import cut, shared_dir


def hilbert_index(steps: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows of ``steps``, values below 2 ** bits)."""
    x = [steps[:, i].astype(np.int64).copy() for i in range(steps.shape[1])]
    n = len(x)
    # turn each level's cell to the curve's direction, from the coarsest to the finest
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(upper, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(x[0]), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros(len(x[0]), np.int64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | (((v ^ flip) >> level) & 1)
    return out


def _step(values: pd.Series, bounds: np.ndarray) -> np.ndarray:
    """Step of each value: the middle of the bounds equal to it, so that few distinct values spread over all steps."""
    known = values.notna().to_numpy()
    own = values[known].to_numpy(bounds.dtype)
    out = np.zeros(len(values), np.int64)
    out[known] = (np.searchsorted(bounds, own, "left") + np.searchsorted(bounds, own, "right")) // 2
    return out


def _index_udf(bounds: list[np.ndarray], bits: int):
    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([_step(c, b) for b, c in zip(bounds, cols)], axis=1), bits))
    return index


def _comparable(df: DataFrame, name: str) -> Column:
    """Texts as they are (compared whole, by code point), all else as a double."""
    return F.col(name).cast("string" if dict(df.dtypes)[name] in ("string", "binary") else "double")


def text_quantiles(df: DataFrame, name: str, bits: int) -> list[str]:
    """The 2 ** bits - 1 quantiles of a column of texts over all rows, repeats kept.

    The distinct values, with their counts, are range-sorted and summed up part by part; the quantiles alone go to the driver.
    """
    n = 1 << bits
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    part = cut(values.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
               .withColumn("_part", F.spark_partition_id()))
    sums = part.groupBy("_part").agg(F.sum("n").alias("s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = sums.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"),
                       F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
    placed = part.withColumn("upto", upto).join(sums, "_part").withColumn("upto", F.col("before") + F.col("upto"))
    k = F.expr(f"sequence((upto - n) * {n} div all + 1, least(upto * {n} div all, {n - 1}L))")
    own = placed.where(f"(upto - n) * {n} div all + 1 <= least(upto * {n} div all, {n - 1}L)").select("v", F.explode(k).alias("k"))
    return [r.v for r in own.orderBy("k").collect()]


def quantile_bounds(df: DataFrame, dims: list[str], bits: int, error: float = 0.005) -> list[np.ndarray]:
    """2 ** bits - 1 step bounds for each column, repeats kept: quantiles of all rows (approximate for numbers)."""
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    rows = df.select([_comparable(df, d).alias(f"d{i}") for i, d in enumerate(dims)])
    kinds = dict(rows.dtypes)
    numbers = [c for c in rows.columns if kinds[c] == "double"]
    found = dict(zip(numbers, rows.select(numbers).approxQuantile(numbers, share, error))) if numbers else {}
    return [np.array(found[c], np.float64) if c in found else np.array(text_quantiles(rows, c, bits), object) for c in rows.columns]


def curve_shards(docs: DataFrame, dims: list[str], shards: int = 16, bits: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, size, text_crc32, curve, law, shard, slot, grown_shard)."""
    text = F.col(text_col).cast("string")
    bounds = quantile_bounds(docs, dims, bits)
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"),
        _index_udf(bounds, bits)(*[_comparable(docs, d) for d in dims]).alias("own"))
    rows = cut(rows)  # texts are read once
    group = rows.groupBy("digest").agg(F.min("own").alias("curve"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(group, "digest", "left").withColumn("curve", F.coalesce("curve", "own")).drop("own")
    order = ["curve", "digest", "doc_id", "size"]
    # the checkpoint fixes partitions and order, which the positions rest on
    shared_dir(docs.sparkSession)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())  # one number for each partition
    total = sum(c for _, c in counts)
    before, offsets = 0, []
    for p, c in counts:
        offsets.append((p, before))
        before += c
    starts = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    at = F.col("before") + place
    return (rows.join(F.broadcast(starts), part == F.col("part")).withColumn("pos", at)
            .withColumn("shard", F.expr(f"cast((pos * {shards}) div {max(total, 1)} as int)"))
            .withColumn("slot", F.col("pos") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}"))
            .select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows as Parquet, one folder per shard, each file a run of the curve (ids must be unique).

    Files hold runs because rows are range-partitioned on (shard, slot), so a
    large shard is written by several tasks.
    """
    place = assigned.select(F.col("doc_id").alias("_id"), "shard", "slot", "curve")
    (docs.join(place, docs[id_col] == place["_id"]).drop("_id").repartitionByRange("shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
