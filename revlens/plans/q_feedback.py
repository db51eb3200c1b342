"""Registered feedback, upsert, set and content-id queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.catalog import register
from revlens.functions.lookups import normalise_severity
from revlens.operators import feedback as FB
from revlens.operators import metrics as M
from revlens.plans.sql import NORM_SEV, RATE, ci, pct, with_fixtures
from revlens.sources.fixtures import fixture

_LATEST = """(SELECT review_id, accepted FROM (
   SELECT review_id, accepted, row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, feedback_id DESC) AS rn
   FROM feedback) WHERE rn = 1)"""
_APPLIED = f"""(SELECT r.* REPLACE (CAST(coalesce(l.accepted, r.accepted) AS INT) AS accepted)
   FROM reviews r LEFT JOIN {_LATEST} l ON r.review_id = l.review_id)"""
# Python's str.isspace() set, RE2 spelling.
_PY_SPACE = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"regexp_replace(rule, '^{_PY_SPACE}+|{_PY_SPACE}+$', '', 'g')"
_CID = (f"(SELECT *, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || "
        f"substring(h, 17, 4) || '-' || substring(h, 21, 12) AS cid FROM (SELECT *, "
        f"sha256(coalesce(category, 'general') || ':' || coalesce(language, '') || ':' || {_STRIP}) AS h "
        f"FROM conventions WHERE {_STRIP} <> ''))")


def reviews(spark, sf):
    return fixture(spark, sf, "reviews")


def feedback(spark, sf):
    return fixture(spark, sf, "feedback")


@register("W02_latest_feedback", with_fixtures(f"SELECT review_id, accepted FROM {_LATEST}", "feedback"))
def w02(spark, sf):
    return FB.latest_feedback(feedback(spark, sf))


ORACLE_J05 = with_fixtures(f"SELECT review_id, repo, accepted FROM {_APPLIED}", "reviews", "feedback")


@register("J05_apply_feedback", ORACLE_J05)
def j05(spark, sf):
    return FB.apply_feedback(reviews(spark, sf), feedback(spark, sf)).select("review_id", "repo", "accepted")


@register("J05_A05_breakdown_after_feedback", with_fixtures(f"""
SELECT repo, count(*) AS total_reviews,
       {ci(NORM_SEV + " = 'critical'")} AS critical, {ci(NORM_SEV + " = 'high'")} AS high,
       {ci(NORM_SEV + " = 'medium'")} AS medium, {ci(NORM_SEV + " = 'low'")} AS low,
       {ci('accepted = 1')} AS accepted, {ci('accepted = 0')} AS rejected,
       {RATE} AS acceptance_rate, {pct(RATE)} AS acceptance_pct
FROM {_APPLIED} GROUP BY repo""", "reviews", "feedback"))
def j05a(spark, sf):
    return M.repo_breakdown(FB.apply_feedback(reviews(spark, sf), feedback(spark, sf)))


@register("J06_unknown_feedback", with_fixtures(
    "SELECT feedback_id, review_id FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.review_id = f.review_id)",
    "reviews", "feedback"))
def j06(spark, sf):
    return FB.unknown_feedback(feedback(spark, sf), reviews(spark, sf)).select("feedback_id", "review_id")


@register("S12_review_upsert", with_fixtures(
    f"SELECT review_id, repo, severity, accepted FROM {_APPLIED}", "reviews", "feedback"))
def s12(spark, sf):
    r = reviews(spark, sf)
    fb = feedback(spark, sf)
    updates = (r.join(FB.latest_feedback(fb).withColumnRenamed("accepted", "_a"), "review_id")
               .withColumn("accepted", F.col("_a").cast("int")).drop("_a"))
    return FB.upsert(r, updates, "review_id").select("review_id", "repo", "severity", "accepted")


@register("U03_record_merge", with_fixtures(f"""
SELECT r.review_id, CAST(l.accepted AS VARCHAR) AS accepted, r.severity
FROM reviews r JOIN {_LATEST} l ON r.review_id = l.review_id""", "reviews", "feedback"))
def u03(spark, sf):
    r = reviews(spark, sf)
    latest = FB.latest_feedback(feedback(spark, sf)).withColumnRenamed("accepted", "_new")
    meta = F.create_map(F.lit("accepted"), F.col("accepted").cast("string"), F.lit("severity"), F.col("severity"))
    upd = F.create_map(F.lit("accepted"), F.col("_new").cast("string"))
    m = r.join(latest, "review_id").select("review_id", FB.merge_metadata(meta, upd).alias("meta"))
    return m.select("review_id", F.col("meta")["accepted"].alias("accepted"), F.col("meta")["severity"].alias("severity"))


@register("X15_F17_convention_content_id", with_fixtures(f"""
SELECT convention_id AS source_id, cid AS convention_id, coalesce(category, 'general') AS category,
       coalesce(language, '') AS language, coalesce(added_by, 'system') AS added_by, coalesce(repo, '') AS repo
FROM {_CID}""", "conventions"))
def x15(spark, sf):
    c = fixture(spark, sf, "conventions").withColumnRenamed("convention_id", "source_id").drop("embedding")
    p = FB.prepare_conventions(c)
    return p.select("source_id", "convention_id", "category", "language", "added_by", "repo")


@register("S13_U04_convention_upsert", with_fixtures(f"""
SELECT DISTINCT cid AS convention_id, coalesce(category, 'general') AS category, coalesce(language, '') AS language
FROM {_CID}""", "conventions"))
def s13(spark, sf):
    c = fixture(spark, sf, "conventions").drop("embedding", "convention_id")
    p = FB.prepare_conventions(c)
    # loading the same rules twice must not duplicate them (content id upsert)
    again = FB.prepare_conventions(c)
    merged = FB.upsert(FB.dedupe_by_content(p), again, "convention_id")
    return merged.select("convention_id", "category", "language")


@register("U01_U02_severity_union", with_fixtures(f"""
SELECT source, severity, count(*) AS n FROM (
  SELECT 'review' AS source, {NORM_SEV} AS severity FROM reviews
  UNION ALL SELECT 'finding', severity FROM findings) GROUP BY ALL""", "reviews", "findings"))
def u01(spark, sf):
    a = reviews(spark, sf).select(F.lit("review").alias("source"), normalise_severity("severity").alias("severity"))
    b = fixture(spark, sf, "findings").select(F.lit("finding").alias("source"), "severity")
    return a.unionByName(b).groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("U02_distinct_categories", with_fixtures("""
SELECT DISTINCT category FROM (SELECT category FROM reviews UNION ALL SELECT category FROM findings)""",
    "reviews", "findings"))
def u02(spark, sf):
    a = reviews(spark, sf).select("category")
    b = fixture(spark, sf, "findings").select("category")
    return a.unionByName(b).distinct()
