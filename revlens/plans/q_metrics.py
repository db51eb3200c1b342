"""Registered metric, store and filter queries over the review table."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.catalog import register
from revlens.functions.text import preview
from revlens.operators import filters as FL
from revlens.operators import metrics as M
from revlens.operators.ordering import with_position
from revlens.plans.sql import NORM_SEV, RATE, ci, pct, with_fixtures, with_store
from revlens.sources import store
from revlens.sources.fixtures import fixture

# Filter parameters used by the history-page queries.
REPO = "src11"
SEVERITY = "WARNING"
CATEGORY = "bug"
SEARCH = "  the "


def reviews(spark, sf):
    return fixture(spark, sf, "reviews")


def store_rows(spark, sf):
    return store.load_reviews(reviews(spark, sf))


def conventions(spark, sf):
    return fixture(spark, sf, "conventions")


# ---------------------------------------------------------------- A05 (flagship)
ORACLE_A05 = with_fixtures(f"""
SELECT repo, count(*) AS total_reviews,
       CAST(count_if({NORM_SEV} = 'critical') AS BIGINT) AS critical, CAST(count_if({NORM_SEV} = 'high') AS BIGINT) AS high,
       CAST(count_if({NORM_SEV} = 'medium') AS BIGINT) AS medium, CAST(count_if({NORM_SEV} = 'low') AS BIGINT) AS low,
       CAST(count_if(accepted = 1) AS BIGINT) AS accepted, CAST(count_if(accepted = 0) AS BIGINT) AS rejected,
       {RATE} AS acceptance_rate, {pct(RATE)} AS acceptance_pct
FROM reviews GROUP BY repo ORDER BY repo""", "reviews")


@register("A05_repo_breakdown", ORACLE_A05)
def a05(spark, sf):
    return M.repo_breakdown(reviews(spark, sf))


@register("A01_acceptance_rate", with_fixtures(f"SELECT {RATE} AS acceptance_rate FROM reviews", "reviews"))
def a01(spark, sf):
    return M.acceptance_rate(reviews(spark, sf))


@register("A01_acceptance_rate_repo", with_fixtures(
    f"SELECT {RATE} AS acceptance_rate FROM reviews WHERE repo = '{REPO}'", "reviews"))
def a01r(spark, sf):
    return M.acceptance_rate(reviews(spark, sf), REPO)


@register("A02_rate_rollup", with_fixtures(f"""
SELECT coalesce(repo, '(all)') AS repo, CAST(grouping(repo) AS INT) AS is_total,
       {RATE} AS acceptance_rate, {pct(RATE)} AS acceptance_pct
FROM reviews GROUP BY ROLLUP (repo)""", "reviews"))
def a02(spark, sf):
    return M.acceptance_rate_rollup(reviews(spark, sf))


@register("A03_rate_by_category", with_fixtures(f"""
SELECT category, count(*) AS total_reviews, CAST(count_if(accepted <> -1) AS BIGINT) AS rated,
       {RATE} AS acceptance_rate, {pct(RATE)} AS acceptance_pct
FROM reviews GROUP BY category""", "reviews"))
def a03(spark, sf):
    return M.rate_by_category(reviews(spark, sf))


@register("A04_severity_counts", with_fixtures(
    f"SELECT {NORM_SEV} AS severity, count(*) AS count FROM reviews GROUP BY 1", "reviews"))
def a04(spark, sf):
    return M.severity_counts(reviews(spark, sf))


def _date_text(df):
    # dates leave the registered queries as ISO text (engine-neutral)
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


ORACLE_A06 = with_store(
    "SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS issues FROM store WHERE date IS NOT NULL GROUP BY date")


@register("A06_issues_per_day", ORACLE_A06)
def a06(spark, sf):
    return _date_text(M.issues_per_day(store_rows(spark, sf)))


@register("A07_category_counts", with_store(
    "SELECT category, count(*) AS count FROM store GROUP BY category"))
def a07(spark, sf):
    return M.value_counts(store_rows(spark, sf), "category")


_CONV_VIEW = """SELECT convention_id, rule, coalesce(category, 'general') AS category,
       CASE WHEN coalesce(language, '') = '' THEN 'all' ELSE language END AS language,
       CASE WHEN coalesce(repo, '') = '' THEN 'global' ELSE repo END AS repo,
       coalesce(added_by, 'system') AS added_by FROM conventions"""


@register("A08_conventions_by_category", with_fixtures(
    f"SELECT category, count(*) AS count FROM ({_CONV_VIEW}) GROUP BY category", "conventions"))
def a08(spark, sf):
    return M.value_counts(store.load_conventions(conventions(spark, sf)), "category")


@register("A09_conventions_by_language", with_fixtures(
    f"SELECT language, count(*) AS count FROM ({_CONV_VIEW}) GROUP BY language", "conventions"))
def a09(spark, sf):
    return M.value_counts(store.load_conventions(conventions(spark, sf)), "language")


@register("A10_kpis", with_fixtures(f"""
SELECT count(*) AS total_reviews, count(DISTINCT repo) AS repositories, {RATE} AS acceptance_rate,
       CAST(count_if({NORM_SEV} = 'critical') AS BIGINT) AS critical_issues, {pct(RATE)} AS acceptance_pct
FROM reviews""", "reviews"))
def a10(spark, sf):
    return M.kpis(reviews(spark, sf))


FIRST_DAY, LAST_DAY = "2024-01-02", "2024-01-03"


@register("A10_kpis_of_days", with_store(f"""
SELECT 'all' AS span, count(*) AS total_reviews, count(DISTINCT repo) AS repositories, {RATE} AS acceptance_rate,
       CAST(count_if({NORM_SEV} = 'critical') AS BIGINT) AS critical_issues, {pct(RATE)} AS acceptance_pct FROM store
UNION ALL
SELECT 'range', count(*), count(DISTINCT repo), {RATE}, CAST(count_if({NORM_SEV} = 'critical') AS BIGINT), {pct(RATE)} FROM store
WHERE date BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'"""))
def a10_days(spark, sf):
    """The same measures added up from daily rows, over all days and over a range."""
    daily = M.daily_kpis(store_rows(spark, sf))
    return (M.kpis_of_days(daily).withColumn("span", F.lit("all"))
            .unionByName(M.kpis_of_days(daily, FIRST_DAY, LAST_DAY).withColumn("span", F.lit("range"))))


@register("O02_values_in_order", with_store("""
SELECT category, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, category) AS position FROM store GROUP BY category"""))
def o02(spark, sf):
    """Most frequent first, ties by name; the position is part of the result."""
    return with_position(M.value_counts(store_rows(spark, sf), "category"), [F.desc("count"), "category"])


@register("O03_rates_in_order", with_fixtures(f"""
SELECT category, {RATE} AS acceptance_rate, row_number() OVER (ORDER BY {RATE} DESC, category) AS position,
       row_number() OVER (ORDER BY {RATE}, category) AS from_lowest FROM reviews GROUP BY category""", "reviews"))
def o03(spark, sf):
    """Rates from the highest and from the lowest."""
    rates = M.rate_by_category(reviews(spark, sf)).select("category", "acceptance_rate")
    down = with_position(rates, [F.desc("acceptance_rate"), "category"])
    return with_position(down, [F.asc("acceptance_rate"), "category"], "from_lowest")


@register("O04_repositories_in_order", with_fixtures("""
SELECT repo, count(*) AS total_reviews, row_number() OVER (ORDER BY repo) AS position FROM reviews GROUP BY repo""", "reviews"))
def o04(spark, sf):
    return with_position(M.repo_breakdown(reviews(spark, sf)).select("repo", "total_reviews"), ["repo"])


@register("A19_filter_choices", with_store("""
SELECT field, value, is_all FROM (
  SELECT DISTINCT 'repo' AS field, repo AS value, false AS is_all FROM store WHERE repo IS NOT NULL
  UNION ALL SELECT DISTINCT 'severity', severity, false FROM store WHERE severity IS NOT NULL
  UNION ALL SELECT DISTINCT 'category', category, false FROM store WHERE category IS NOT NULL
  UNION ALL SELECT f, 'All', true FROM (VALUES ('repo'), ('severity'), ('category')) t(f))"""))
def a19(spark, sf):
    return M.filter_choices(store_rows(spark, sf))


@register("A20_showing_counts", with_store(f"""
SELECT CAST(count_if(repo = '{REPO}' AND severity = '{SEVERITY}' AND regexp_matches(comment, '{SEARCH.strip()}', 'i')) AS BIGINT) AS shown,
       count(*) AS total FROM store"""))
def a20(spark, sf):
    return M.showing_counts(store_rows(spark, sf), repo=REPO, severity=SEVERITY, search=SEARCH)


@register("A24_mix_report", with_fixtures("""
SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(accepted) = 0 THEN 'accepted' ELSE 'repo' END AS dimension,
       coalesce(severity, accepted, repo) AS value, count(*) AS n,
       count(*) / (SELECT count(*) FROM reviews) AS share
FROM (SELECT severity, CAST(accepted AS VARCHAR) AS accepted, repo FROM reviews)
GROUP BY GROUPING SETS ((severity), (accepted), (repo))""", "reviews"))
def a24(spark, sf):
    return M.mix_report(reviews(spark, sf))


@register("A24_time_range", with_fixtures("""
SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_ts,
       count(*) AS n_rows FROM reviews""", "reviews"))
def a24t(spark, sf):
    return M.time_range(reviews(spark, sf))


# ---------------------------------------------------------------- store scans
@register("S07_load_reviews", with_store(
    "SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date, substring(comment, 1, 200) AS comment, "
    "substring(snippet, 1, 100) AS snippet) FROM store"))
def s07(spark, sf):
    return _date_text(store.list_view(store_rows(spark, sf)))


@register("S08_load_conventions", with_fixtures(_CONV_VIEW, "conventions"))
def s08(spark, sf):
    return store.load_conventions(conventions(spark, sf))


@register("S09_get_filtered", with_fixtures(
    f"SELECT review_id, accepted, severity FROM reviews WHERE repo = '{REPO}' AND accepted <> -1", "reviews"))
def s09(spark, sf):
    r = reviews(spark, sf)
    return store.get(r, (F.col("repo") == REPO) & (F.col("accepted") != -1), ["review_id", "accepted", "severity"])


@register("S10_get_by_ids", with_fixtures(
    "SELECT review_id, repo, accepted FROM reviews WHERE review_id IN (SELECT review_id FROM feedback)",
    "reviews", "feedback"))
def s10(spark, sf):
    ids = fixture(spark, sf, "feedback")
    return store.get_by_ids(reviews(spark, sf), ids).select("review_id", "repo", "accepted")


@register("S11_counts", with_fixtures(
    f"SELECT count(*) AS n_rows, CAST(count_if(repo = '{REPO}') AS BIGINT) AS n_matching FROM reviews", "reviews"))
def s11(spark, sf):
    return store.counts(reviews(spark, sf), F.col("repo") == REPO)


# ---------------------------------------------------------------- filters
@register("F08_repo_scope", with_fixtures(
    f"SELECT review_id, repo FROM reviews WHERE repo = '{REPO}'", "reviews"))
def f08(spark, sf):
    return FL.repo_scope(reviews(spark, sf), REPO).select("review_id", "repo")


@register("F09_language_or_global", with_fixtures(
    "SELECT convention_id, language FROM conventions WHERE language IN ('python', '')", "conventions"))
def f09(spark, sf):
    return FL.language_or_global(conventions(spark, sf), "python").select("convention_id", "language")


@register("F10_rated_only", with_fixtures(
    "SELECT review_id, accepted FROM reviews WHERE accepted <> -1", "reviews"))
def f10(spark, sf):
    return FL.rated(reviews(spark, sf)).select("review_id", "accepted")


_HIST_STATUS = ("CASE accepted WHEN 1 THEN '✅ Accepted' WHEN 0 THEN '❌ Rejected' "
                "WHEN -1 THEN '— Unrated' ELSE '— Unrated' END")


@register("F11_history_filters", with_store(f"""
SELECT review_id, repo, file, severity, category, timestamp, substring(comment, 1, 200) AS comment, {_HIST_STATUS} AS status
FROM store WHERE repo = '{REPO}' AND severity = '{SEVERITY}' AND category = '{CATEGORY}'"""))
def f11(spark, sf):
    return M.history_rows(store_rows(spark, sf), repo=REPO, severity=SEVERITY, category=CATEGORY)


@register("F12_comment_search", with_store(f"""
SELECT review_id, repo, file, severity, category, timestamp, substring(comment, 1, 200) AS comment, {_HIST_STATUS} AS status
FROM store WHERE regexp_matches(comment, '{SEARCH.strip()}', 'i')"""))
def f12(spark, sf):
    return M.history_rows(store_rows(spark, sf), search=SEARCH)


@register("F13_valid_dates", with_store(
    "SELECT review_id, strftime(date, '%Y-%m-%d') AS date FROM store WHERE date IS NOT NULL"))
def f13(spark, sf):
    return _date_text(FL.with_valid_date(store_rows(spark, sf)).select("review_id", "date"))


@register("F14_convention_browser", with_fixtures(f"""
SELECT convention_id, category, language, repo, added_by,
       CASE WHEN length(rule) > 80 THEN concat(substring(rule, 1, 80), '…') ELSE rule END AS title,
       CASE WHEN language <> 'all' THEN language ELSE 'all languages' END AS language_tag
FROM ({_CONV_VIEW}) WHERE category = 'security'""", "conventions"))
def f14(spark, sf):
    c = FL.category_filter(store.load_conventions(conventions(spark, sf)), "security")
    return c.select("convention_id", "category", "language", "repo", "added_by",
                    preview("rule", 80).alias("title"),
                    F.when(F.col("language") != "all", F.col("language"))
                    .otherwise(F.lit("all languages")).alias("language_tag"))
