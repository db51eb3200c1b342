"""Unified-diff parsing.

A diff file becomes language, added lines, removed lines and hunk ranges
with higher-order array functions: the work is row-local (no explode, no
shuffle) and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions.lookups import language_of
from revlens.functions.text import cap, split_lines, token_estimate
from revlens.session import spread

# Fixed value: the hunk header pattern of unified diffs.
HUNK_HEADER_RE = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_source(raw: DataFrame) -> DataFrame:
    """Diff-file rows with patch NULL -> ''."""
    return raw.withColumn("patch", F.coalesce(F.col("patch"), F.lit("")))


def with_patch(df: DataFrame) -> DataFrame:
    """files without a patch (binary files) are skipped."""
    return df.filter(F.coalesce(F.col("patch"), F.lit("")) != "")


def hunk_ranges(lines: Column) -> Column:
    """Header lines -> array<struct<start,length>>, length defaults to 1."""
    headers = F.filter(lines, lambda l: l.rlike(HUNK_HEADER_RE))
    return F.transform(headers, lambda l: F.struct(
        F.regexp_extract(l, HUNK_HEADER_RE, 1).try_cast("int").alias("start"),
        F.when(F.regexp_extract(l, HUNK_HEADER_RE, 2) == "", F.lit(1))
         .otherwise(F.regexp_extract(l, HUNK_HEADER_RE, 2).try_cast("int")).alias("length")))


def _content(lines: Column, mark: str) -> Column:
    """Lines starting with the mark (but not a triple mark), mark removed,
    empty results dropped (whitespace-only lines are kept)."""
    triple = mark * 3
    picked = F.filter(lines, lambda l: l.startswith(mark) & ~l.startswith(triple) & (F.length(l) > 1))
    return F.transform(picked, lambda l: F.substring(l, 2, 1 << 30))


def changed_files(diff_files: DataFrame) -> DataFrame:
    """Parsed changed files (F07 + X01-X04), one row per file with a patch."""
    lines = split_lines(F.col("patch"))
    return (spread(with_patch(diff_files))
            .withColumn("language", language_of("filename"))
            .withColumn("_lines", lines)
            .withColumn("added_lines", _content(F.col("_lines"), "+"))
            .withColumn("removed_lines", _content(F.col("_lines"), "-"))
            .withColumn("hunks", hunk_ranges(F.col("_lines")))
            .drop("_lines"))


def review_input(changed: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The patch (capped where asked) and its token estimate for the model input."""
    patch = F.col("patch") if max_chars is None else cap(F.col("patch"), max_chars)
    return (changed.withColumn("patch_text", patch)
            .withColumn("patch_tokens", token_estimate(patch)))


def diff_lines(diff_files: DataFrame) -> DataFrame:
    """X03 as a line table: (file key, line no, class, text), via posexplode.

    Used where per-line joins are needed (function facts, line positions).
    """
    lines = split_lines(F.coalesce(F.col("patch"), F.lit("")))
    t = diff_files.select("*", F.posexplode(lines).alias("line_no", "text"))
    cls = (F.when(F.col("text").rlike(HUNK_HEADER_RE), F.lit("hunk"))
           .when(F.col("text").startswith("+") & ~F.col("text").startswith("+++"), F.lit("added"))
           .when(F.col("text").startswith("-") & ~F.col("text").startswith("---"), F.lit("removed"))
           .otherwise(F.lit("other")))
    return t.withColumn("kind", cls)
