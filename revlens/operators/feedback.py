"""Feedback and store updates.

Plain Parquet has no MERGE, so an upsert is expressed as
``union -> latest row per key -> write a new table version``.  "Latest per
key" is an aggregation (``max_by`` over an ordering struct), not a window,
so a key with very many updates is combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import now_iso, py_strip


def latest_feedback(feedback: DataFrame, key: str = "review_id", value: str = "accepted",
                    order=("ts", "feedback_id")) -> DataFrame:
    """The latest mark per review wins (ordered by ts, then id)."""
    return feedback.groupBy(key).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(value))


def apply_feedback(reviews: DataFrame, feedback: DataFrame, key: str = "review_id") -> DataFrame:
    """Set ``accepted`` from the latest feedback; other columns untouched."""
    fb = latest_feedback(feedback, key).withColumnRenamed("accepted", "_fb_accepted")
    return (reviews.join(fb, key, "left")
            .withColumn("accepted", F.coalesce(F.col("_fb_accepted"), F.col("accepted")).cast("int"))
            .drop("_fb_accepted"))


def unknown_feedback(feedback: DataFrame, reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """Feedback whose review id does not exist (reported, not failed)."""
    return feedback.join(reviews.select(key), key, "left_anti")


def upsert(existing: DataFrame, updates: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Rows of ``updates`` replace rows of ``existing`` with the same key.

    Columns that ``updates`` does not have keep their stored values (NULL for
    a new key).  Among several updates of one key the greatest ``seq`` wins,
    then the greatest row, so the result does not depend on the order of rows.
    """
    carried = [c for c in existing.columns if c in updates.columns and c != key]
    kept = [c for c in existing.columns if c not in carried and c != key]
    order = F.struct(*([F.col(seq)] if seq else []), F.xxhash64(*updates.columns))
    u = updates.groupBy(key).agg(F.max_by(F.struct(F.lit(True).alias("_new"), *carried), order).alias("_u"))
    j = existing.withColumnsRenamed({c: f"_e_{c}" for c in existing.columns if c != key}).join(u, key, "full")
    new = F.col("_u._new").isNotNull()
    return j.select(*[F.col(key) if c == key else
                      F.when(new, F.col(f"_u.{c}")).otherwise(F.col(f"_e_{c}")).alias(c) if c in carried else
                      F.col(f"_e_{c}").alias(c) for c in existing.columns])


def fill_timestamp(ts: str = "timestamp") -> Column:
    """An empty stamp becomes the current UTC time (ISO text)."""
    c = F.col(ts)
    return F.when(F.coalesce(c, F.lit("")) == "", now_iso()).otherwise(c)


def content_id(*parts) -> Column:
    """SHA-256 of 'category:language:rule' (rule stripped) as 8-4-4-4-12."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def convention_id(category="category", language="language", rule="rule") -> Column:
    return content_id(F.col(category), F.col(language), py_strip(F.col(rule)))


def random_id() -> Column:
    """A random UUID.  Non-deterministic: use only where a row is
    created once (a sink), never on a path a retry may recompute."""
    return F.expr("uuid()")


def prepare_conventions(rules: DataFrame, repo_override: str | None = None) -> DataFrame:
    """F17 + X15: skip blank rules, apply defaults, assign the content id."""
    from revlens.operators.filters import non_blank_rules
    df = non_blank_rules(rules)
    df = (df.withColumn("rule", py_strip(F.col("rule")))
          .withColumn("language", F.coalesce(F.col("language"), F.lit("")))
          .withColumn("category", F.coalesce(F.col("category"), F.lit("general")))
          .withColumn("added_by", F.coalesce(F.col("added_by"), F.lit("system")))
          .withColumn("repo", F.lit(repo_override) if repo_override else F.coalesce(F.col("repo"), F.lit(""))))
    return df.withColumn("convention_id", convention_id())


def dedupe_by_content(conventions: DataFrame) -> DataFrame:
    """One row per content id (the id is a pure function of the content,
    so any survivor is equivalent)."""
    return conventions.dropDuplicates(["convention_id"])


def merge_metadata(meta: Column, updates: Column) -> Column:
    """Map merge where the right side wins (needs LAST_WIN dedup policy)."""
    return F.map_concat(meta, updates)
