"""Interval-overlap join: functions x diff hunks in the same file.

Functions carry 0-based inclusive line ranges; hunks are 1-based
(start, length).  A function overlaps a hunk when
``f.start <= h.start + h.length - 2`` and ``f.end >= h.start - 1``.

Plan: both sides are cut into fixed-width line buckets and equi-joined on
(file, bucket); the residual overlap test runs inside the join.  A pair is
emitted only in the first bucket both ranges share, so no pair repeats and
no DISTINCT is needed.  A large file with many functions and hunks thus
never becomes one all-pairs group: each function meets only the hunks of
the buckets it spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BUCKET_LINES = 64


def _bucket_span(lo, hi, width: int):
    return F.sequence(F.floor(F.least(lo, hi) / width).cast("long"),
                      F.floor(F.greatest(lo, hi) / width).cast("long"))


def functions_in_hunks(functions: DataFrame, hunks: DataFrame, file_key: str = "file_id",
                       bucket_lines: int = DEFAULT_BUCKET_LINES) -> DataFrame:
    """All (function, hunk) pairs of the same file whose ranges overlap."""
    w = bucket_lines
    f = functions.select(
        *[F.col(c).alias(c) for c in functions.columns],
        F.explode(_bucket_span(F.col("start_line"), F.col("end_line"), w)).alias("_b"))
    h_lo = F.col("start") - 1
    h_hi = F.col("start") + F.col("length") - 2
    h = hunks.select(
        F.col(file_key).alias("_hf"), F.col("hunk_id"), F.col("start").alias("hunk_start"),
        F.col("length").alias("hunk_length"),
        F.explode(_bucket_span(h_lo, h_hi, w)).alias("_hb"))
    cond = ((F.col(file_key) == F.col("_hf")) & (F.col("_b") == F.col("_hb"))
            & (F.col("start_line") <= F.col("hunk_start") + F.col("hunk_length") - 2)
            & (F.col("end_line") >= F.col("hunk_start") - 1))
    first_common = F.greatest(
        F.floor(F.col("start_line") / w),
        F.floor(F.least(F.col("hunk_start") - 1, F.col("hunk_start") + F.col("hunk_length") - 2) / w)
    ).cast("long")
    return (f.join(h, cond, "inner")
            .filter(F.col("_b") == first_common)
            .drop("_b", "_hb", "_hf"))
