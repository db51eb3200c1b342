"""Operator 12: Merkle manifest of a dataset by concatenated-level strings.

The rows of a group, in order, are cut into aligned blocks of ``arity ** levels``
nodes.  A block keeps each of its levels as one string of hex digests: a parent
is the SHA-256 of a fixed-width substring (``arity`` digests, fewer at the end),
and a node's siblings are the two substrings that flank it in its run.  The
blocks' top nodes are the nodes of the next pass, until one node is left to a
group.  The groups' roots, in order, are hashed the same way into the root.

A proof is the list of segments (what stands left and right of the node in its
run) from leaf to root; :func:`fold` recomputes a root from a leaf and them.

All is DataFrame functions; a block is the most that a task gathers, and a group
that holds a third of all rows is spread over many blocks.  Positions come from
a range sort (:mod:`revlens.llm.ranks`).

Defined cases: null values are hashed as ``-``; a null group comes first and is
distinct from an empty one; rows with a null id come before the others of their
group; rows that share an id are ordered by their leaf, then by the tampered
leaf, and each has its own proof; an empty text is ``0:``; an empty table gives
an empty result; further columns are ignored, names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import cut
from revlens.llm.ranks import positions

HEX = 64
SEGMENTS = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _parents(level: str, arity: int) -> str:
    """SQL: the string of the parents of the nodes in ``level``."""
    run = HEX * arity
    return (f"cast(array_join(transform(sequence(0, (length({level}) - 1) div {run}), "
            f"i -> sha2(substring({level}, i * {run} + 1, {run}), 256)), '') as binary)")


def _segment(level: str, at: str, arity: int) -> str:
    """SQL: what stands left and right of node ``at`` in its run of ``level``."""
    run = HEX * arity
    return (f"named_struct('l', cast(substring({level}, ({at} div {arity}) * {run} + 1, ({at} % {arity}) * {HEX}) as string), "
            f"'r', cast(substring({level}, ({at} + 1) * {HEX} + 1, ({arity - 1} - {at} % {arity}) * {HEX}) as string))")


def _one_pass(nodes: DataFrame, group: list[str], carry: list[str], arity: int, levels: int) -> DataFrame:
    """Blocks of (group, pos, h, carry): (group, pos of the block, h of its top, rows), where rows hold each node's
    carried columns and its segments within the block."""
    width = arity ** levels
    size = nodes.groupBy(*group).agg(F.max("pos").alias("_last"))
    blocks = nodes.groupBy(*group, F.floor(F.col("pos") / width).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "h", *carry))).alias("_rows"))
    blocks = blocks.join(size, group)
    # levels are binary, so that a substring costs its own length; a level above the group's top is empty
    df = blocks.withColumn("_s0", F.expr("cast(array_join(transform(_rows, x -> x.h), '') as binary)"))
    for k in range(levels):
        more = f"case when _last >= {arity ** k} then {_parents(f'_s{k}', arity)} else cast('' as binary) end"
        df = df.withColumn(f"_s{k + 1}", F.expr(more))
    tops = ", ".join(f"_s{k}" for k in range(levels, -1, -1))
    segments = ", ".join(f"case when _last >= {arity ** k} then {_segment(f'_s{k}', f'(x.pos % {width} div {arity ** k})', arity)} end"
                         for k in range(levels))
    kept = "".join(f", '{c}', x.{c}" for c in carry)
    return df.select(
        *group, F.col("block").alias("pos"),
        F.expr(f"cast(filter(array({tops}), s -> length(s) > 0)[0] as string)").alias("h"),
        F.expr(f"transform(_rows, x -> named_struct('pos', x.pos{kept}, 'segs', "
               f"cast(filter(array({segments}), s -> s is not null) as {SEGMENTS})))").alias("rows"), "_last")


def tree(nodes: DataFrame, group: list[str], carry: list[str], arity: int = 3, levels: int = 5) -> DataFrame:
    """Proofs of the nodes (group, pos, h, carry) up to their group's root.

    ``pos`` counts from 0 without gaps in each group, ``h`` is a hex digest.
    Returns (group, root, carry, segs) with one row per node; segs is the list of
    (l, r) from the node to the root.
    """
    passes, now, kept, width = [], nodes, carry, arity ** levels
    while True:
        made = cut(_one_pass(now, group, kept, arity, levels))
        passes.append(made)
        if made.where(f"_last >= {width}").isEmpty():
            break
        now, kept = made.select(*group, "pos", "h"), []
    # from the top: each block's segments and root are appended to those of its rows
    up = passes[-1].select(*group, F.col("pos").alias("block"), F.col("h").alias("root"),
                           F.array().cast(SEGMENTS).alias("upper"))
    for i in range(len(passes) - 1, -1, -1):
        names = carry if i == 0 else []
        rows = passes[i].withColumnRenamed("pos", "block").drop("h", "_last")
        rows = (rows.join(up, [*group, "block"]).select(*group, "root", "upper", F.explode("rows").alias("_x"))
                .select(*group, "root", F.expr("concat(_x.segs, upper)").alias("segs"), F.col("_x.pos").alias("block"),
                        *[F.col(f"_x.{c}").alias(c) for c in names]))
        up = rows.withColumnRenamed("segs", "upper")
    return rows.drop("block")


def fold(start: Column, segs: Column) -> Column:
    """The root that follows from a leaf and its segments."""
    return F.aggregate(segs, start, lambda h, s: F.sha2(F.concat(s.l, h, s.r), 256))


def proof_digest(segs: Column) -> Column:
    """Digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(segs, lambda s: F.concat(s.l, s.r)), ""), 256)


def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id",
             fields: tuple = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None,
             arity: int = 3, levels: int = 5) -> DataFrame:
    """One row per document: (doc_id, leaf, check_leaf, subroot, root, segs).

    ``check_leaf`` is the leaf with the last field replaced by ``tampered`` (the
    leaf itself where none is given); ``segs`` leads from the leaf through the
    group's subroot to the root.
    """
    values = [F.col(c) for c in fields]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("key"),  # null first
        F.col(id_col).alias("id"), leaf(*values).alias("h"),
        (leaf(*values) if tampered is None else leaf(*values[:-1], tampered)).alias("check"))
    # texts are read once; only digests are sorted
    placed = positions(cut(rows), ["key"], [F.col("id").asc_nulls_first(), "h", "check"])
    low = tree(placed.withColumn("leaf", F.col("h")), ["key"], ["id", "leaf", "check"], arity, levels)
    low = cut(low.withColumnRenamed("root", "subroot").withColumnRenamed("segs", "low"))
    roots = low.groupBy("key").agg(F.first("subroot").alias("h")).withColumn("whole", F.lit(0))
    high = tree(positions(roots, ["whole"], ["key"]), ["whole"], ["key"], arity, levels)
    return low.join(high, "key").select(
        F.col("id").alias("doc_id"), "leaf", F.col("check").alias("check_leaf"), "subroot", "root",
        F.concat("low", "segs").alias("segs"))


def tampering(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without line breaks where 2 divides crc32 of the id as text, else as it is."""
    even = F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


def verify(docs: DataFrame, **options) -> DataFrame:
    """Manifest of all documents, and whether each row, tampered by :func:`tampering`, still leads to the root."""
    made = manifest(docs, tampered=tampering(), **options)
    return (made.withColumn("folded_root", fold(F.col("check_leaf"), F.col("segs")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("segs")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
