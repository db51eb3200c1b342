"""Operator 3: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are word n-grams.  Two
documents link when ``|x & y| / |x | y| >= num / den``; every link implies an
overlap of at least ``num / den`` of either size, and that size-derived bound
discards work at each step:

1. *Sets*: every whole text becomes its set of n-gram hashes; documents with
   the same set share one representative (the smallest id).
2. *Column blocks*: a fixed share of the hash space is cut into column blocks
   of bounded size.  Map tasks send each block their part of the matrix, with
   n-grams that repeat inside the task sent once.  A block returns, by
   document, how many of its n-grams occur elsewhere.  A document with more
   lonely n-grams than the bound allows cannot link with anything.
3. *Prefixes*: among the remaining documents, n-grams are ordered from rare to
   frequent.  Linked documents share one of the first ``n - bound + 1``;
   documents that share such an n-gram fall into one candidate group.
4. *Row blocks*: the product is taken inside candidate groups, by pairs of
   row blocks, accumulating overlap counts over column chunks and stopping
   when no pair can still reach its bound.  The first block of a large group
   is multiplied with all others first; blocks already joined by verified
   links are not multiplied with each other, so a large group of copies costs
   in proportion to its size.

Defined cases: a null or wordless text has an empty set and links with
nothing; a text with fewer words than n has its whole sequence as its one
n-gram; a row with a null id is returned and links with nothing; rows with the
same id and different texts are judged by their own texts; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, cut, drop, slices
from revlens.llm.components import components

#: Share of the hash space (of 256 parts) that step 2 looks at.  Any share gives right results: a document is dropped
#: only when the lonely n-grams seen in it are already too many (a document of which none are seen is kept).
COLUMN_SHARE = 100
#: N-grams in a column block, n-grams that a map task holds, documents in a row block, columns in a chunk.
BLOCK_ENTRIES, CHUNK_ENTRIES, ROW_BLOCK, COLUMN_CHUNK = 1_500_000, 1_000_000, 512, 4096
#: Column blocks at least, so that a document's counts come from about as many blocks at any size.
LEAST_BLOCKS = 64

_META = "doc_id long, n_shingles long, d1 long, d2 long"
_SETS = "doc_id long, n long, grams binary"
_LINKS = "a long, b long"


def _sets(batches, size):
    """(ids, valid ids, hashes, first index per document) for slices of the batches (doc_id, text, ...)."""
    for batch in batches:
        ids = batch.column(0)
        for a, b, body, off in slices(batch.column(1)):
            h, first = H.shingle_sets(body, off, size)
            yield batch, a, b, ids.slice(a, b - a), h, first


def _digests(h, first):
    """128-bit hash of each set."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(h) + 1, H.U)
        np.cumsum(H.mix(h ^ H.U(salt)), out=total[1:])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out


def _column_blocks(size, blocks, share):
    """Map side of step 2: rows (block, keys, place of each key's document in ids, ids, adds)."""
    names = ["block", "keys", "place", "ids", "adds"]
    alone = np.uint16(0xFFFF)

    def flush(hs, docs, ids):
        h, doc = np.concatenate(hs), np.concatenate(docs)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        same = h[1:] == h[:-1]
        new = np.r_[True, ~same]
        repeated = np.r_[same, False] | np.r_[False, same]
        own = np.bincount(doc[repeated], minlength=len(ids)).astype(np.uint32)
        doc = np.where(repeated, alone, doc.astype(np.uint16))[new]
        h = h[new]
        block = (((h >> H.U(32)) & H.U(0xFFFF)) * H.U(blocks) >> H.U(16)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        h, doc, block = h[order], doc[order], block[order]
        begin = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        rows = [[], [], [], [], []]
        for i, j in zip(begin[:-1], begin[1:]):
            part = doc[i:j]
            used = np.unique(part)
            place = np.searchsorted(used, part).astype(np.uint16)
            place[part == alone] = alone
            used = used[used != alone]
            for r, v in zip(rows, (int(block[i]), (h[i:j] & H.U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                                   place.tobytes(), ids[used].tobytes(), b"")):
                r.append(v)
        at = np.flatnonzero(own)
        if len(at):
            for r, v in zip(rows, (int(h[0] % H.U(blocks)) if len(h) else 0, b"", b"", ids[at].tobytes(),
                                   own[at].tobytes())):
                r.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32())] + [pa.array(r, pa.binary())
                                                                            for r in rows[1:]], names)

    def run(batches):
        seen: dict[tuple[int, int], None] = {}
        hs, docs, ids, entries = [], [], [], 0
        for _, _, _, own_ids, h, first in _sets(batches, size):
            d1, d2 = _digests(h, first)
            n = np.diff(first)
            keep = np.zeros(len(n), bool)
            valid = np.asarray(own_ids.is_valid())
            for k in np.flatnonzero((n > 0) & valid):  # one copy of equal sets stands for the rest
                key = (int(d1[k]), int(d2[k]))
                if key not in seen:
                    seen[key] = None
                    keep[k] = True
            doc = np.repeat(np.arange(len(n)), n)
            pick = keep[doc] & ((h >> H.U(56)) < H.U(share))
            doc = doc[pick]
            kept = np.flatnonzero(keep)
            base = sum(map(len, ids))
            if base + len(kept) >= 0xFFFF or entries > CHUNK_ENTRIES:
                if entries:
                    yield flush(hs, docs, np.concatenate(ids))
                hs, docs, ids, entries, base = [], [], [], 0, 0
            hs.append(h[pick])
            docs.append(np.searchsorted(kept, doc) + base)
            ids.append(own_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[kept])
            entries += len(doc)
        if entries:
            yield flush(hs, docs, np.concatenate(ids))
    return run


def _column_counts(table: pa.Table) -> pa.Table:
    """Reduce side of step 2: by document, how many of a block's n-grams other documents have too."""
    keys, places, ids, base, adds = [], [], [], 0, []
    for k, p, i, a in zip(*(table.column(c).to_pylist() for c in ("keys", "place", "ids", "adds"))):
        own = np.frombuffer(i, np.int64)
        if a:
            adds.append((own, np.frombuffer(a, np.uint32).astype(np.int64)))
            continue
        place = np.frombuffer(p, np.uint16).astype(np.int64)
        places.append(np.where(place == 0xFFFF, -1, place + base))
        keys.append(np.frombuffer(k, np.uint32))
        ids.append(own)
        base += len(own)
    out_ids, out_n = [x[0] for x in adds], [x[1] for x in adds]
    if keys:
        key, place, own = np.concatenate(keys), np.concatenate(places), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        same = key[1:] == key[:-1]
        shared = (np.r_[same, False] | np.r_[False, same]) & (place >= 0)
        n = np.bincount(place[shared], minlength=len(own))
        out_ids.append(own[n > 0])
        out_n.append(n[n > 0])
    return pa.table({"doc_id": pa.array(np.concatenate(out_ids) if out_ids else np.zeros(0, np.int64)),
                     "shared": pa.array(np.concatenate(out_n) if out_n else np.zeros(0, np.int64))})


def _share_counts(size, share):
    """(doc_id, seen): n-grams of each document inside the share of the hash space, for the sets' own digests."""
    def run(batches):
        for _, _, _, ids, h, first in _sets(batches, size):
            d1, d2 = _digests(h, first)
            total = np.r_[0, np.cumsum((h >> H.U(56)) < H.U(share))]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(np.diff(first)), pa.array(d1), pa.array(d2),
                 pa.array((total[first[1:]] - total[first[:-1]]).astype(np.int64))],
                ["doc_id", "n_shingles", "d1", "d2", "seen"])
    return run


def _set_rows(size):
    """(doc_id, n, grams) of the rows (doc_id, text, d1, d2) whose set has that digest."""
    def run(batches):
        for batch, a, b, ids, h, first in _sets(batches, size):
            d1, d2 = _digests(h, first)
            w1 = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
            w2 = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)
            pick = np.flatnonzero((d1 == w1) & (d2 == w2))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(pick)).cast(pa.int64()), pa.array(np.diff(first)[pick]),
                 pa.array([h[first[k]:first[k + 1]].tobytes() for k in pick], pa.binary())], ["doc_id", "n", "grams"])
    return run


def _explode(batches):
    """(gram, doc_id) of the rows (doc_id, n, grams)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        grams = batch.column(2).to_pylist()
        a = 0
        while a < len(grams):
            b, total = a, 0
            while b < len(grams) and (b == a or total + len(grams[b]) < 8_000_000):
                total += len(grams[b])
                b += 1
            g = np.frombuffer(b"".join(grams[a:b]), np.int64)
            n = np.array([len(x) // 8 for x in grams[a:b]])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.repeat(ids[a:b], n))], ["gram", "doc_id"])
            a = b


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each index of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    far = len(linked)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], far).min(axis=1, initial=far))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def overlap_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Boolean matrix (left rows x right rows) of linked pairs: the sparse product of two row blocks."""
    n = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), n)
    grams, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    keep = times[col] > 1
    rows, col = rows[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    a, b = n[left][:, None], n[right][None, :]
    # overlap * (num + den) >= num * (a + b)
    need = -(-num * (a + b) // (num + den))
    viable = (num * np.maximum(a, b) <= den * np.minimum(a, b)) & (a > 0) & (b > 0)
    seen = np.zeros(need.shape, np.float32)
    rest = np.bincount(rows, minlength=len(sets))
    for c in range(0, width, COLUMN_CHUNK):
        if not viable.any():
            break
        i, j = np.searchsorted(col, (c, c + COLUMN_CHUNK))
        part = np.zeros((len(sets), min(COLUMN_CHUNK, width - c)), np.float32)
        part[rows[i:j], col[i:j] - c] = 1
        seen += part[left] @ part[right].T
        rest = rest - np.bincount(rows[i:j], minlength=len(sets))
        viable &= seen + np.minimum(rest[left][:, None], rest[right][None, :]) >= need
    return viable & (seen >= need)


def _product(num, den):
    """Star links of each row-block pair; rows (g1, g2, g3, side, doc_id, grams) sorted by the first three."""
    def links(ids, side, sets):
        ids, side = np.array(ids), np.array(side)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        full = np.zeros((len(ids), len(ids)), bool)
        if len(right):
            m = overlap_links(sets, left, right, num, den)
            full[np.ix_(left, right)] = m
            full[np.ix_(right, left)] = m.T
        else:
            full = overlap_links(sets, left, left, num, den)
        np.fill_diagonal(full, False)
        order = np.argsort(ids, kind="stable")
        label = local_components(full[np.ix_(order, order)])
        ids = ids[order]
        at = np.flatnonzero(label != np.arange(len(ids)))
        return ids[at], ids[label[at]]

    def run(batches):
        key, ids, side, sets = None, [], [], []
        out_a, out_b, held = [], [], 0
        for batch in batches:
            for g1, g2, g3, s, i, g in zip(*(c.to_pylist() for c in batch.columns)):
                if (g1, g2, g3) != key:
                    if len(ids) > 1:
                        a, b = links(ids, side, sets)
                        out_a.append(a)
                        out_b.append(b)
                        held += len(a)
                    key, ids, side, sets = (g1, g2, g3), [], [], []
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)),
                                                          pa.array(np.concatenate(out_b))], ["a", "b"])
                        out_a, out_b, held = [], [], 0
                ids.append(i)
                side.append(s)
                sets.append(np.frombuffer(g, H.U))
        if len(ids) > 1:
            a, b = links(ids, side, sets)
            out_a.append(a)
            out_b.append(b)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a).astype(np.int64)),
                                              pa.array(np.concatenate(out_b).astype(np.int64))], ["a", "b"])
    return run


def _block_links(tasks: DataFrame, num: int, den: int) -> DataFrame:
    keys = ["g1", "g2", "g3"]
    return (tasks.select(*keys, "side", "doc_id", "grams").repartition(*keys).sortWithinPartitions(*keys, "side")
            .mapInArrow(_product(num, den), _LINKS))


def _candidate_groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, component_id): groups of documents that share a rare n-gram of their prefixes."""
    grams = sets.mapInArrow(_explode, "gram long, doc_id long")
    lists = cut(grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("doc_id").alias("head"),
                                          F.max("doc_id").alias("tail"))
                .where("head < tail").select("gram", "df", "head"))
    size = sets.groupBy("doc_id").agg(F.max("n").alias("n"))
    shared = grams.join(lists, "gram").join(size, "doc_id")
    by_doc = Window.partitionBy("doc_id")
    prefix = (shared.withColumn("shared", F.count("*").over(by_doc))
              .withColumn("place", F.row_number().over(by_doc.orderBy("df", "gram")))
              .where(f"place + n - shared <= n - ceil(n * {num} / {den}) + 1"))
    return components(prefix.where("doc_id <> head").select("doc_id", "head").distinct(), "doc_id", "head")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                 num: int = 3, den: int = 4) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    ``component_id`` is the smallest id reachable over links of similarity
    ``num / den`` or more, the document's own id included.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    meta = cut(base.mapInArrow(_share_counts(size, COLUMN_SHARE), _META + ", seen long"))
    reps = cut(meta.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2")
               .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("seen").alias("seen")))
    total = reps.agg(F.sum("seen")).first()[0] or 0
    blocks = min(0xFFFF, max(LEAST_BLOCKS, -(-total // BLOCK_ENTRIES)))
    shared = (base.mapInArrow(_column_blocks(size, blocks, COLUMN_SHARE),
                              "block int, keys binary, place binary, ids binary, adds binary")
              .groupBy("block").applyInArrow(_column_counts, "doc_id long, shared long")
              .groupBy("doc_id").agg(F.sum("shared").alias("shared")))
    # lonely n-grams seen must not exceed n - ceil(n * num / den); a copy elsewhere may have stood for the representative
    stood = meta.select("doc_id", "d1", "d2").join(shared, "doc_id").groupBy("d1", "d2").agg(F.max("shared").alias("shared"))
    # a set without a row has no shared n-gram inside the share of the hash space; it may have some outside of it
    left = cut(reps.join(cut(stood), ["d1", "d2"], "left")
               .where(f"seen - coalesce(shared, 0) <= n - ceil(n * {num} / {den})").select("rep", "d1", "d2"))
    # by merge at any size: a broadcast of the remaining ids is bounded only by their number
    sets = cut(base.join(left.hint("merge"), base.doc_id == left.rep).select("doc_id", "text", "d1", "d2")
               .mapInArrow(_set_rows(size), _SETS))
    links = _verified(sets, _candidate_groups(sets, num, den), num, den)
    drop(sets)  # the links are a table of their own
    found = components(links)
    by_set = cut(reps.join(found, F.col("rep") == F.col("id"), "left")
                 .select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id")))
    return (meta.join(by_set, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles",
                    F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
                    .otherwise(F.col("doc_id")).alias("component_id")))


def _verified(sets: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the product inside candidate groups, as stars; see step 4 of the module's text."""
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("size"))
    members = (sets.join(groups, sets.doc_id == groups.id).join(sizes, "component_id")
               .select(F.col("component_id").alias("grp"), "doc_id", "grams",
                       F.ceil(F.col("size") / ROW_BLOCK).cast("int").alias("blocks"))
               .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    members = cut(members)
    zero = F.lit(0)
    diagonal = members.select(F.col("grp").alias("g1"), F.col("block").alias("g2"), F.col("block").alias("g3"),
                              zero.alias("side"), "doc_id", "grams")
    wide = members.where("blocks > 1")
    with_first = wide.where("block > 0").select(F.col("grp").alias("g1"), zero.alias("g2"), F.col("block").alias("g3"),
                                                F.lit(1).alias("side"), "doc_id", "grams")
    first = wide.where("block = 0").select(F.col("grp").alias("g1"), zero.alias("g2"),
                                           F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("g3"),
                                           zero.alias("side"), "doc_id", "grams")
    links = cut(_block_links(diagonal.unionByName(with_first).unionByName(first), num, den))
    if not wide.take(1):
        drop(members)
        return links
    # what of the large groups is still apart
    now = components(links)
    named = wide.join(now, wide.doc_id == now.id, "left").select(
        "grp", "doc_id", "grams", F.coalesce("component_id", "doc_id").alias("part"))
    parts = named.groupBy("grp", "part").agg(F.count("*").alias("size"))
    split = parts.groupBy("grp").agg(F.count("*").alias("parts"),
                                     F.sum(F.when(F.col("size") < ROW_BLOCK, F.col("size")).otherwise(0)).alias("loose"))
    parts = cut(parts.join(split.where("parts > 1"), "grp"))
    big = F.col("size") >= ROW_BLOCK
    named = cut(named.join(parts, ["grp", "part"]).select(
        "grp", "doc_id", "grams", F.when(big, F.col("part")).alias("whole"),
        F.pmod(F.xxhash64("doc_id"), F.ceil(F.when(big, F.col("size")).otherwise(F.col("loose")) / ROW_BLOCK))
        .cast("int").alias("chunk")))
    drop(members)
    blocks = named.select("grp", "whole", "chunk").distinct().withColumn(
        "name", F.concat_ws(":", F.coalesce(F.col("whole").cast("string"), F.lit("-")), F.col("chunk").cast("string")))
    blocks = cut(blocks)
    other = blocks.select("grp", F.col("whole").alias("whole2"), F.col("name").alias("name2"))
    pairs = blocks.join(other, "grp").where("name <= name2 and not coalesce(whole = whole2, false)")
    pairs = cut(pairs.select("grp", "name", "name2"))
    rows = named.withColumn("own", F.concat_ws(":", F.coalesce(F.col("whole").cast("string"), F.lit("-")),
                                               F.col("chunk").cast("string"))).drop("whole", "chunk")
    one = rows.join(pairs, (rows.grp == pairs.grp) & (rows.own == pairs.name)).select(
        rows.grp.alias("g1"), F.col("name").alias("g2"), F.col("name2").alias("g3"), zero.alias("side"), "doc_id", "grams")
    two = rows.join(pairs.where("name < name2"), (rows.grp == pairs.grp) & (rows.own == pairs.name2)).select(
        rows.grp.alias("g1"), F.col("name").alias("g2"), F.col("name2").alias("g3"), F.lit(1).alias("side"), "doc_id", "grams")
    links = cut(links.unionByName(_block_links(one.unionByName(two), num, den)))
    drop(named)
    return links
