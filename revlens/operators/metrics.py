"""Review-table metrics.

Every measure is one aggregation with conditional aggregates, so a loop over
repositories or categories becomes a single shuffle with map-side partial
aggregation (a hot repository is combined before the exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.lookups import normalise_severity
from revlens.functions.text import percent_text
from revlens.operators.filters import ALL, comment_matches, history_filter, with_valid_date


def acceptance_rate_expr(acc: str = "accepted") -> Column:
    """Rated rows only; accepted share; 0.0 when nothing is rated."""
    a = F.col(acc)
    return F.coalesce(F.try_divide(F.count_if(a == 1).cast("double"), F.count_if(a != -1)), F.lit(0.0))


def acceptance_rate(reviews: DataFrame, repo: str | None = None) -> DataFrame:
    """Whole table, or one repository."""
    df = reviews if repo is None else reviews.filter(F.col("repo") == repo)
    return df.agg(acceptance_rate_expr().alias("acceptance_rate"))


def acceptance_rate_rollup(reviews: DataFrame) -> DataFrame:
    """Per-repo and overall rate in one pass (ROLLUP)."""
    return (reviews.rollup("repo")
            .agg(acceptance_rate_expr().alias("acceptance_rate"),
                 F.grouping("repo").cast("int").alias("is_total"))
            .select(F.coalesce("repo", F.lit("(all)")).alias("repo"), "is_total", "acceptance_rate",
                    percent_text("acceptance_rate").alias("acceptance_pct")))


def rate_by_category(reviews: DataFrame) -> DataFrame:
    """Total, rated and rate per category (rate descending)."""
    return (reviews.groupBy("category")
            .agg(F.count(F.lit(1)).alias("total_reviews"),
                 F.count_if(F.col("accepted") != -1).alias("rated"),
                 acceptance_rate_expr().alias("acceptance_rate"))
            .withColumn("acceptance_pct", percent_text("acceptance_rate"))
            .orderBy(F.desc("acceptance_rate"), "category"))


def severity_counts(reviews: DataFrame) -> DataFrame:
    """Counts by normalised severity, most frequent first."""
    return (reviews.groupBy(normalise_severity("severity").alias("severity"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "severity"))


def repo_breakdown(reviews: DataFrame) -> DataFrame:
    """Per repository: totals by normalised severity, accepted, rejected, rate."""
    sev = normalise_severity("severity")
    acc = F.col("accepted")
    return (reviews.groupBy("repo")
            .agg(F.count(F.lit(1)).alias("total_reviews"),
                 F.count_if(sev == "critical").alias("critical"),
                 F.count_if(sev == "high").alias("high"),
                 F.count_if(sev == "medium").alias("medium"),
                 F.count_if(sev == "low").alias("low"),
                 F.count_if(acc == 1).alias("accepted"),
                 F.count_if(acc == 0).alias("rejected"),
                 acceptance_rate_expr().alias("acceptance_rate"))
            .withColumn("acceptance_pct", percent_text("acceptance_rate"))
            .orderBy("repo"))


def issues_per_day(store_rows: DataFrame) -> DataFrame:
    """Rows per valid date (F13 drops rows without one)."""
    return (with_valid_date(store_rows).groupBy("date")
            .agg(F.count(F.lit(1)).alias("issues")).orderBy("date"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, most frequent first, ties by name."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), col))


def kpis(reviews: DataFrame, approx: bool = False) -> DataFrame:
    """A10: total reviews, distinct repos, acceptance rate, critical count.

    ``approx=True`` uses a HyperLogLog sketch for the distinct count, which
    avoids the distinct-key shuffle at very large scale.
    """
    distinct = (F.approx_count_distinct("repo") if approx else F.count_distinct("repo"))
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        distinct.alias("repositories"),
        acceptance_rate_expr().alias("acceptance_rate"),
        F.count_if(normalise_severity("severity") == "critical").alias("critical_issues"),
    ).withColumn("acceptance_pct", percent_text("acceptance_rate"))


#: fixed value: 2 ** 12 registers, a relative standard error of 1.04 / 2 ** 6 = 1.6 %
SKETCH_SIZE = 12


def daily_kpis(store_rows: DataFrame) -> DataFrame:
    """A10 by day, in a form that adds up: counts, and a sketch of the repositories.

    ``store_rows`` is the store view (S07).  Rows without a valid date stand
    under a NULL date.
    """
    acc = F.col("accepted")
    return (store_rows.groupBy("date")
            .agg(F.count(F.lit(1)).alias("total_reviews"), F.count_if(acc == 1).alias("accepted"), F.count_if(acc != -1).alias("rated"),
                 F.count_if(normalise_severity("severity") == "critical").alias("critical_issues"),
                 F.hll_sketch_agg("repo", F.lit(SKETCH_SIZE)).alias("repositories")))


def kpis_of_days(daily: DataFrame, first=None, last=None) -> DataFrame:
    """A10 over the days from ``first`` to ``last`` (both included, None: open, and then undated rows too) from daily rows.

    The number of repositories is an estimate from the united sketches (see
    ``SKETCH_SIZE``; exact for a few thousand); all else is exact.
    """
    days = daily
    if first is not None:
        days = days.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.filter(F.col("date") <= F.lit(last).cast("date"))
    return (days.agg(F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews"),
                     F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("repositories")), F.lit(0)).alias("repositories"),
                     F.coalesce(F.try_divide(F.sum("accepted").cast("double"), F.sum("rated")), F.lit(0.0)).alias("acceptance_rate"),
                     F.coalesce(F.sum("critical_issues"), F.lit(0)).alias("critical_issues"))
            .withColumn("acceptance_pct", percent_text("acceptance_rate")))


def filter_choices(reviews: DataFrame, fields=("repo", "severity", "category")) -> DataFrame:
    """Sorted distinct non-null values per field, with 'All' first.

    One row per (field, value), all fields from one scan; the distinct step is
    a shuffle on (field, value) and the order a distributed range sort, never
    a collect.
    """
    stacked = reviews.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    values = stacked.filter(F.col("value").isNotNull()).distinct().withColumn("is_all", F.lit(False))
    alls = reviews.sparkSession.createDataFrame([(f, ALL, True) for f in fields],
                                                "field string, value string, is_all boolean")
    return values.unionByName(alls).orderBy("field", F.desc("is_all"), "value")


def showing_counts(reviews: DataFrame, repo: str = ALL, severity: str = ALL,
                   category: str = ALL, search: str = "") -> DataFrame:
    """A20: 'Showing x of y' — filtered and total counts in one pass."""
    pred = F.lit(True)
    if repo != ALL:
        pred = pred & (F.col("repo") == repo)
    if severity != ALL:
        pred = pred & (F.col("severity") == severity)
    if category != ALL:
        pred = pred & (F.col("category") == category)
    if search.strip():
        pred = pred & comment_matches(search)
    return reviews.agg(F.count_if(pred).alias("shown"), F.count(F.lit(1)).alias("total"))


def history_rows(reviews: DataFrame, **filters) -> DataFrame:
    """F11/F12 + X11: the filtered history table with status labels; filters
    see whole texts, the shown comment is cut."""
    from revlens import schemas as S
    from revlens.functions.lookups import history_status
    from revlens.functions.text import cap
    return (history_filter(reviews, **filters)
            .select("review_id", "repo", "file", "severity", "category", "timestamp",
                    cap("comment", S.LIST_COMMENT_CHARS).alias("comment"),
                    history_status("accepted").alias("status")))


def mix_report(reviews: DataFrame) -> DataFrame:
    """Severity, acceptance and repository shares (GROUPING SETS).

    Every row falls in exactly one group per dimension, so the share's
    denominator is the row count, computed once as a scalar subquery.
    """
    df = reviews.select("severity", F.col("accepted").cast("string").alias("accepted"), "repo")
    return reviews.sparkSession.sql(
        """SELECT CASE WHEN grouping(severity) = 0 THEN 'severity'
                       WHEN grouping(accepted) = 0 THEN 'accepted' ELSE 'repo' END AS dimension,
                  coalesce(severity, accepted, repo) AS value, count(1) AS n,
                  count(1) / (SELECT count(1) FROM {df}) AS share
           FROM {df} GROUP BY GROUPING SETS ((severity), (accepted), (repo))""", df=df)


def time_range(reviews: DataFrame) -> DataFrame:
    """First and last review time, as ISO text."""
    from revlens.functions.text import ts_to_iso
    return reviews.agg(ts_to_iso(F.min("ts")).alias("first_ts"), ts_to_iso(F.max("ts")).alias("last_ts"),
                       F.count(F.lit(1)).alias("n_rows"))
