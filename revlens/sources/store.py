"""Review / convention store scans.

The store is a Parquet table; reads apply the read-time defaults the review
store uses for missing metadata, so NULL never reaches a sentinel column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions.text import cap, empty_to, iso_to_date, ts_to_iso


def with_timestamp_text(reviews: DataFrame) -> DataFrame:
    """Stored stamps are ISO text; derive it from a ``ts`` column if present."""
    if "timestamp" in reviews.columns:
        return reviews
    return reviews.withColumn("timestamp", F.coalesce(ts_to_iso("ts"), F.lit("")))


def load_reviews(reviews: DataFrame) -> DataFrame:
    """Full scan with defaults, whole texts and the derived date (see ``list_view`` for display)."""
    r = with_timestamp_text(reviews)
    return r.select(
        "review_id",
        F.coalesce("repo", F.lit("")).alias("repo"),
        F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce("severity", F.lit("WARNING")).alias("severity"),
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce(F.col("accepted").cast("int"), F.lit(S.UNRATED)).alias("accepted"),
        F.col("timestamp"),
        F.coalesce("comment", F.lit("")).alias("comment"),
        F.coalesce("code_snippet", F.lit("")).alias("snippet"),
        iso_to_date("timestamp").alias("date"),
    )


def list_view(loaded: DataFrame) -> DataFrame:
    """S07 for display: comment[:200] and snippet[:100], after all filters."""
    return loaded.withColumns({"comment": cap("comment", S.LIST_COMMENT_CHARS),
                               "snippet": cap("snippet", S.LIST_SNIPPET_CHARS)})


def load_conventions(conventions: DataFrame) -> DataFrame:
    """Full scan; '' language -> 'all', '' repo -> 'global'."""
    return conventions.select(
        "convention_id",
        F.col("rule"),
        F.coalesce("category", F.lit("general")).alias("category"),
        empty_to("language", "all").alias("language"),
        empty_to("repo", "global").alias("repo"),
        F.coalesce("added_by", F.lit("system")).alias("added_by"),
    )


def get(df: DataFrame, where=None, include: list[str] | None = None) -> DataFrame:
    """Filtered, column-selected get (pushdown and pruning by Catalyst)."""
    out = df if where is None else df.filter(where)
    return out if include is None else out.select(*include)


def get_by_ids(df: DataFrame, ids: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows whose id is in ``ids`` (a semi join; ids may be any size)."""
    return df.join(ids.select(key), key, "left_semi")


def counts(df: DataFrame, where=None) -> DataFrame:
    """Plain and filtered row counts in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if where is not None:
        aggs.append(F.count_if(where).alias("n_matching"))
    return df.agg(*aggs)
