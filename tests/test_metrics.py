"""Acceptance rates, severity counts and history filters on literal rows."""

import pytest

from revlens.operators import metrics as M
from revlens.operators.filters import history_filter

SCHEMA = "review_id long, repo string, severity string, category string, accepted int, comment string"


@pytest.fixture
def reviews(spark):
    rows = [(1, "a", "CRITICAL", "bug", 1, "Null deref"), (2, "a", "WARNING", "bug", 1, "n+1 query"),
            (3, "a", "WARNING", "style", 0, None), (4, "a", "SUGGESTION", "style", -1, "naming"),
            (5, "b", "medium", "logic", -1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_rate_excludes_unrated(spark, reviews):
    assert M.acceptance_rate(reviews, "a").first().acceptance_rate == pytest.approx(2 / 3)
    assert M.acceptance_rate(reviews, "b").first().acceptance_rate == 0.0
    assert M.acceptance_rate(reviews, "nope").first().acceptance_rate == 0.0


def test_rollup_both_grains(spark, reviews):
    got = {r.repo: (r.acceptance_rate, r.acceptance_pct) for r in M.acceptance_rate_rollup(reviews).collect()}
    assert got["a"] == (pytest.approx(2 / 3), "67%")
    assert got["b"] == (0.0, "0%")
    assert got["(all)"][0] == pytest.approx(2 / 3)


def test_severity_counts(spark, reviews):
    got = {r.severity: r["count"] for r in M.severity_counts(reviews).collect()}
    assert got == {"critical": 1, "high": 2, "low": 1, "medium": 1}


def test_repo_breakdown(spark, reviews):
    a = [r for r in M.repo_breakdown(reviews).collect() if r.repo == "a"][0]
    assert (a.total_reviews, a.critical, a.high, a.medium, a.low, a.accepted, a.rejected) == (4, 1, 2, 0, 1, 2, 1)
    assert a.acceptance_pct == "67%"


def test_history_filters_and_search(spark, reviews):
    assert history_filter(reviews, repo="a", severity="WARNING").count() == 2
    assert history_filter(reviews, search="  NULL ").count() == 1      # trimmed, case-insensitive
    assert history_filter(reviews, search="n.*query").count() == 1      # regular expression
    assert history_filter(reviews, search="   ").count() == 5           # blank disables
    got = M.showing_counts(reviews, category="style").first()
    assert (got.shown, got.total) == (2, 5)


def test_filter_choices(spark, reviews):
    rows = M.filter_choices(reviews).collect()
    repo_vals = [r.value for r in rows if r.field == "repo"]
    assert repo_vals == ["All", "a", "b"]


def test_kpis_of_days_add_up_and_the_sketch_keeps_its_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(
        F.concat(F.lit("r"), (F.col("id") % 20_000).cast("string")).alias("repo"), F.lit("CRITICAL").alias("severity"),
        (F.col("id") % 3 - 1).cast("int").alias("accepted"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("date"))
    daily = M.daily_kpis(rows)
    got = M.kpis_of_days(daily).first()
    assert got.total_reviews == got.critical_issues == 60_000 and got.acceptance_rate == 0.5
    assert abs(got.repositories - 20_000) < 3 * 1.04 / 2 ** (M.SKETCH_SIZE / 2) * 20_000
    part = M.kpis_of_days(daily, "2024-01-03", "2024-01-04").first()
    exact = rows.filter("date BETWEEN '2024-01-03' AND '2024-01-04'").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("r")).first()
    assert part.total_reviews == exact.n and abs(part.repositories - exact.r) < 0.05 * exact.r
    none = M.kpis_of_days(daily, "2030-01-01").first()
    assert (none.total_reviews, none.repositories, none.acceptance_rate) == (0, 0, 0.0)


def test_positions_follow_the_order(spark):
    from pyspark.sql import functions as F

    from revlens.operators.ordering import with_position

    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(7)
    got = {r.k: r.position for r in with_position(df, [F.desc("k")]).collect()}
    assert got == {k: 500 - k for k in range(500)}
    assert with_position(df.filter("false"), ["k"]).collect() == []
