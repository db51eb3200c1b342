"""Connected components of a link table.

Alternating large-star and small-star steps: each is a map-side combinable
minimum per node and a join, so neither a node with very many neighbours nor a
large component is ever gathered in one task.  The minima are written tables, so
that the join has a plain exchange on either side and adaptive execution can
split a hub's rows; each round's links are too, so a lost executor costs one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from revlens.llm.common import cut, drop


def _large_star(edges: DataFrame, made: list) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest neighbour."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    out = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
    made += [low, out]
    return out


def _small_star(edges: DataFrame, made: list) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    low = cut(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
    made.append(low)
    return (edges.withColumnRenamed("a", "u").join(low, "u").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every linked id; component_id is its smallest id.

    ``links`` holds pairs of ids in any order, with repeats; null ids and
    self-links are ignored.  An empty table gives an empty result.  The number
    of rounds grows with the logarithm of the longest path.
    """
    last, round_no, made = None, 0, []
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    while True:
        seen = Observation(f"round {round_no}")
        edges = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
        for old in made:  # all of the round before
            drop(old)
        now = (seen.get["n"], seen.get["x"])  # the links are stable when their checksum is
        if now == last or now[0] == 0:
            break
        last, round_no, made = now, round_no + 1, [edges]
        edges = _small_star(_large_star(edges, made), made)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
