"""Operator 1: embedding near-dedup with a pivot-permutation index.

* *Description*: at most ``pivots`` reference vectors come from a bounded sample
  (the ``sample`` rows with the smallest hash of their components; every row is
  described), none closer to another than a cosine of ``apart``, so a dense
  group of copies gets one pivot and not many that trade places.  They are
  ranked by cosine for each vector; its nearest ``nearest`` describe it.
* *Inverted lists*: pairs that share at least ``common`` of their pivots are
  candidates.  Sharing that many is the same as sharing one combination of
  ``common`` pivots, so the lists are keyed by (label, combination), which
  keeps them short.  Equal vectors enter once, with their count.
* *Shared-pivot counts*: in a list, counts of common pivots come from the
  product of the pivot incidence rows; a pair is taken in its first common list
  only, so each is verified and counted once.
* *Verification*: cosines in double precision by matrix products of blocks of
  ``block`` vectors; a list longer than that becomes block pairs, so a list of
  any length is spread over tasks.  Blocks return link counts and a spanning
  set of links, never the pairs.

No list, candidate or partner is capped.  Recall against brute force is tested
(0.9 at least); what is found is exact, and with ``common=1`` and all pivots near
every pair of a label meets.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite
components, and vectors with a null label, link with nothing; vectors of
different lengths don't link; a null id is returned alone; rows with the same
id and different vectors add up their links; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import cut
from revlens.llm.components import components
from revlens.llm.ngram_jaccard import local_components

_LISTS = "label string, cell long, rep long, times long, near binary, vec binary"
_FOUND = "rep long, links long, other long"


def choose_pivots(vecs: list, most: int, apart: float) -> np.ndarray:
    """The first vectors, as unit vectors of the first one's length, that are no closer than ``apart`` to one before."""
    width = len(vecs[0])
    chosen = np.zeros((0, width))
    for v in vecs:
        x = np.zeros(width)
        x[:len(v)] = v[:width]
        size = np.abs(x).max()
        if size > 0:
            x = x / size
            x /= np.linalg.norm(x)
            if not len(chosen) or (chosen @ x).max() < apart:
                chosen = np.vstack([chosen, x])
                if len(chosen) == most:
                    break
    return chosen


def _describe(pivots: np.ndarray, nearest: int, common: int):
    """Rows (label, rep, times, vec) to one row for each combination of ``common`` of the nearest pivots."""
    take = min(nearest, len(pivots))
    pick = np.array(list(combinations(range(take), min(common, take))))
    weight = len(pivots) ** np.arange(pick.shape[1])[::-1]

    def run(batches):
        for batch in batches:
            label, rep, times = batch.column(0), batch.column(1), batch.column(2)
            vecs = batch.column(3).to_pylist()
            for a in range(0, len(vecs), 2000):
                part = vecs[a:a + 2000]
                dim = max(map(len, part)) // 8
                # vectors of other lengths are described by their leading components
                x = np.zeros((len(part), max(dim, pivots.shape[1])))
                for i, v in enumerate(part):
                    x[i, :len(v) // 8] = np.frombuffer(v)
                score = x[:, :pivots.shape[1]] @ pivots.T
                near = np.sort(np.argsort(-score, axis=1, kind="stable")[:, :take].astype(np.int16), axis=1)
                cells = (near[:, pick].astype(np.int64) * weight).sum(axis=2)
                row = pa.array(np.repeat(np.arange(len(part)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([
                    label.slice(a, len(part)).take(row), pa.array(cells.ravel()), rep.slice(a, len(part)).take(row),
                    times.slice(a, len(part)).take(row),
                    pa.array([v.tobytes() for v in near], pa.binary()).take(row),
                    pa.array(part, pa.binary()).take(row)], ["label", "cell", "rep", "times", "near", "vec"])
    return run


def list_links(near: np.ndarray, vecs: np.ndarray, side: np.ndarray, cell: int, pivots: int, common: int,
               least: float) -> np.ndarray:
    """Symmetric matrix of the links whose first common list is this one.

    With both sides present only pairs across them count.
    """
    names = []
    for _ in range(common):
        names.append(cell % pivots)
        cell //= pivots
    last = max(names)
    # common pivots up to the list's last one: exactly the list's own for a pair that first meets here
    has = np.zeros((len(near), last + 1), np.float32)
    rows = np.repeat(np.arange(len(near)), near.shape[1])
    flat = near.ravel()
    has[rows[flat <= last], flat[flat <= last]] = 1
    first_here = has @ has.T == common
    norm = np.linalg.norm(vecs, axis=1)
    cos = (vecs @ vecs.T) / (norm[:, None] * norm[None, :])
    linked = first_here & (cos >= least)
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    return linked


def _verify(pivots: int, common: int, least: float):
    """Sorted rows (label, cell, b1, b2, side, rep, times, near, vec) to (rep, links, other)."""
    def found(key, rows):
        side, rep, times, near, vec = (list(x) for x in zip(*rows))
        rep, times, side = np.array(rep), np.array(times), np.array(side)
        near = np.stack([np.frombuffer(n, np.int16) for n in near])
        out = []
        sizes = np.array([len(v) for v in vec])
        for size in np.unique(sizes):  # one length of vectors as a rule
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(rep[at], kind="stable")]
            x = np.stack([np.frombuffer(vec[i]) for i in at])
            if len(at) < 2 or (key[2] != key[3] and not side[at].any()):
                continue
            linked = list_links(near[at], x, side[at], key[1], pivots, common, least)
            n = linked @ times[at]
            label = local_components(linked)
            hit = np.flatnonzero(n)
            out.append((rep[at[hit]], n[hit], rep[at[label[hit]]]))
        return out

    def batch_of(parts):
        cols = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rep", "links", "other"])

    def run(batches):
        key, rows, parts = None, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k, row in zip(zip(*cols[:4]), zip(*cols[4:])):
                if k != key:
                    if len(rows) > 1:
                        parts += found(key, rows)
                    key, rows = k, []
                    if len(parts) > 500:
                        yield batch_of(parts)
                        parts = []
                rows.append(row)
        if len(rows) > 1:
            parts += found(key, rows)
        if parts:
            yield batch_of(parts)
    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 least: float = 0.93, pivots: int = 256, nearest: int = 6, common: int = 3,
                 block: int = 1024, sample: int = 4096, apart: float = 0.6) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept); links join vectors of one label with cosine
    ``least`` or more."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.coalesce(~bad, F.lit(False)) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
            & F.col(id_col).isNotNull())
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.when(good, v).alias("v"))
    rows = rows.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.transform(
        "v", lambda x: x.cast("string"))), 256)))
    reps = cut(rows.where("v is not null").groupBy("label", "digest")
               .agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v"))
               .mapInArrow(_pack_vectors, "label string, digest string, rep long, times long, vec binary"))
    rows_of = reps.select("digest", "vec").dropDuplicates(["digest"]).orderBy("digest").limit(sample).collect()
    if not rows_of:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    p = choose_pivots([np.frombuffer(r.vec) for r in rows_of], pivots, apart)
    common = min(common, nearest, len(p))
    lists = reps.select("label", "rep", "times", "vec").mapInArrow(_describe(p, nearest, common), _LISTS)
    long_lists = cut(lists.groupBy("label", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
                     .select("label", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    spread = (lists.join(long_lists, ["label", "cell"], "left")
              .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keys = ["label", "cell", "b1", "b2"]
    tasks = (spread.withColumn("other", other).withColumn("b1", F.least("own", "other"))
             .withColumn("b2", F.greatest("own", "other"))
             .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
             .select(*keys, "side", "rep", "times", "near", "vec")
             .repartition(*keys).sortWithinPartitions(*keys))
    found = cut(tasks.mapInArrow(_verify(len(p), common, least), _FOUND))
    linked = cut(found.groupBy("rep").agg(F.sum("links").alias("links")))
    parts = components(found.where("rep <> other"), "rep", "other")
    by_vector = cut(reps.select("label", "digest", "rep", "times").join(linked, "rep", "left")
                    .join(parts, F.col("rep") == F.col("id"), "left")
                    .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                            F.coalesce("component_id", "rep").alias("component_id")))
    return (rows.select("vec_id", "label", "digest").join(by_vector, ["label", "digest"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _pack_vectors(batches):
    """The list column v as bytes of doubles."""
    for batch in batches:
        v = [np.array(x, np.float64).tobytes() for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(v, pa.binary())],
                                         ["label", "digest", "rep", "times", "vec"])
