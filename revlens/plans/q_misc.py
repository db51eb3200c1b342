"""Registered UDF-surface, sequence and generator queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from revlens.catalog import register
from revlens.functions import udf as U
from revlens.operators import diffs as D
from revlens.operators import findings as FD
from revlens.operators import synth as SY
from revlens.plans.q_findings import _VALID
from revlens.sources.fixtures import fixture, with_ctes, with_fixtures
from revlens.sources.tables import load_table

SEED = "revlens"


@register("D01_embed_documents", """
SELECT doc_id, CAST(i AS INT) AS dim,
       round(CAST(('0x' || substring(md5(text), 2 * i + 1, 2)) AS INT) / 255.0, 6) AS value
FROM documents, range(8) t(i)""")
def d01(spark, sf):
    docs = U.embed_column(load_table(spark, sf, "documents"), "text")
    return (docs.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
            .select("doc_id", "dim", F.round("value", 6).alias("value")))


def failing_embedder_factory():
    """The test embedder behind a connection that drops every first call of a batch."""
    base, seen = U.hash_embedder_factory(), set()

    def embed(texts):
        if texts and texts[0] not in seen:
            seen.add(texts[0])
            raise ConnectionError("dropped")
        return base(texts)
    return embed


@register("D02_embedding_after_failures", """
SELECT doc_id, CAST(i AS INT) AS dim, round(CAST(('0x' || substring(md5(coalesce(text, '')), 2 * i + 1, 2)) AS INT) / 255.0, 6) AS value
FROM documents, range(8) t(i)""")
def d02(spark, sf):
    """Every call fails once and is tried again; no vector is missing."""
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    e = d.withColumn("e", U.embedding_udf(failing_embedder_factory, retry_sleep=lambda s: None)(F.col("text")))
    return (e.select("doc_id", F.posexplode("e").alias("dim", "value"))
            .select("doc_id", "dim", F.round("value", 6).alias("value")))


@register("W03_embed_batch_index", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS batch_no FROM documents""")
def w03(spark, sf):
    return U.batch_index(load_table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "batch_no")


def _prompts(spark, sf):
    cf = D.changed_files(fixture(spark, sf, "diff_files"))
    return cf.select("repo", "pr_number", "filename", "language", "added_lines",
                     "patch")


@register("D03_model_enrichment", with_fixtures("""
SELECT repo, pr_number, filename,
       CAST(len(list_filter(added, lambda x: ltrim(x) LIKE 'def %' OR ltrim(x) LIKE 'function %' OR trim(x) = '')) AS INT) AS n_comments,
       len(list_filter(added, lambda x: ltrim(x) LIKE 'def %' OR ltrim(x) LIKE 'function %' OR trim(x) = '')) > 0 AS has_issues
FROM (SELECT repo, pr_number, filename,
             list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++') AND length(x) > 1),
                            lambda x: substring(x, 2)) AS added
      FROM diff_files WHERE coalesce(patch, '') <> '')""", "diff_files"))
def d03(spark, sf):
    out = U.enrich(_prompts(spark, sf), ["repo", "pr_number", "filename"])
    return out.select("repo", "pr_number", "filename", F.size("comments").alias("n_comments"), "has_issues")


# a finding's line in the text of a file review (X26), by its severity
_WORST = r"(?m)^\* -?[0-9]+, {}, "


def flaky_summarizer_factory():
    """A stand-in summariser that fails on PRs with critical findings, so the
    fallback path (A14/A15) is exercised."""
    def summarize(text):
        if re.search(_WORST.format("critical"), text):
            raise RuntimeError("model unavailable")
        verdict = "needs_changes" if re.search(_WORST.format("high"), text) else "approved"
        return {"overall_verdict": verdict, "summary": f"Reviewed: {verdict}."}
    return summarize


def _d04_oracle():
    from revlens.plans.q_findings import _ROLLUP, _X26
    critical, high = (f"regexp_matches(t.findings_text, '{_WORST.format(s)}')" for s in ("critical", "high"))
    return with_fixtures(f"""
SELECT r.repo, r.pr_number,
       CASE WHEN {critical} THEN CASE WHEN r.any_issues THEN 'needs_changes' ELSE 'approved' END
            WHEN {high} THEN 'needs_changes' ELSE 'approved' END AS verdict,
       CASE WHEN {critical} THEN r.fallback_summary
            ELSE 'Reviewed: ' || CASE WHEN {high} THEN 'needs_changes' ELSE 'approved' END || '.' END AS summary_body,
       {critical} AS used_fallback, r.files_reviewed
FROM {_ROLLUP} r JOIN (
  SELECT repo, pr_number, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY filename) AS findings_text
  FROM {_X26} GROUP BY repo, pr_number) t USING (repo, pr_number)""", "findings")


@register("D04_summary_with_fallback", _d04_oracle())
def d04(spark, sf):
    valid = FD.split_valid(fixture(spark, sf, "findings"))[0]
    reviews = FD.file_reviews(valid)
    texts = FD.findings_text(reviews)
    summaries = U.summarize(texts, FD.PR_KEYS, flaky_summarizer_factory, retry_sleep=lambda s: None)
    return U.with_fallback(summaries, FD.pr_rollup(reviews), FD.PR_KEYS)


_G01_CTES = [
    ("vf", f"SELECT * FROM findings WHERE {_VALID}"),
    ("params", "SELECT count(*) AS n FROM documents"),
    ("crit", f"""SELECT finding_id, category, issue, suggestion, 'CRITICAL' AS severity, 'c' || finding_id AS pick_key FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{SEED}:c:' || finding_id), finding_id) - 1 AS r FROM vf WHERE severity = 'critical')
        WHERE r < (SELECT n // 10 FROM params)"""),
    ("warn", f"""SELECT finding_id, category, issue, suggestion, 'WARNING' AS severity, 'w' || finding_id AS pick_key FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{SEED}:w:' || finding_id), finding_id) - 1 AS r FROM vf WHERE severity = 'high')
        WHERE r < (SELECT n // 5 FROM params)"""),
    ("spool", "SELECT *, row_number() OVER (ORDER BY finding_id) - 1 AS pidx FROM vf WHERE severity NOT IN ('critical', 'high')"),
    ("draws", f"""SELECT j, CAST(('0x' || substring(md5('{SEED}:s:' || j), 1, 12)) AS BIGINT) % (SELECT count(*) FROM spool) AS pidx
        FROM (SELECT unnest(range(n - n // 10 - n // 5)) AS j FROM params)"""),
    ("sugg", "SELECT p.finding_id, p.category, p.issue, p.suggestion, 'SUGGESTION' AS severity, 's' || d.j AS pick_key FROM draws d JOIN spool p USING (pidx)"),
    ("picks", "SELECT * FROM crit UNION ALL SELECT * FROM warn UNION ALL SELECT * FROM sugg"),
    ("ordered", f"SELECT *, row_number() OVER (ORDER BY md5('{SEED}:order:' || pick_key)) - 1 AS i FROM picks"),
    ("ids", "SELECT unnest(range(n)) AS id FROM params"),
    ("acc", f"""SELECT id AS i, CAST((row_number() OVER (ORDER BY md5('{SEED}:a:' || id), id) - 1) < (SELECT n * 7 // 10 FROM params) AS INT) AS accepted FROM ids"""),
    ("stamps", f"""SELECT row_number() OVER (ORDER BY ts, id) - 1 AS i, ts FROM (
        SELECT id, (SELECT max(ts) FROM events) - to_seconds(CAST(('0x' || substring(md5('{SEED}:t:' || id), 1, 12)) AS BIGINT) % {SY.SPREAD_SECONDS}) AS ts FROM ids)"""),
    ("rlist", "SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS ridx FROM (SELECT DISTINCT source AS repo FROM documents)"),
    ("rr", f"""SELECT id AS i, (row_number() OVER (ORDER BY md5('{SEED}:r:' || id), id) - 1) % (SELECT count(*) FROM rlist) AS ridx FROM ids"""),
]


@register("G01_synthetic_reviews", with_ctes("""
SELECT o.i, o.pick_key, o.finding_id, o.severity, o.category, o.issue AS comment, o.suggestion AS code_snippet,
       l.repo, a.accepted, strftime(s.ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts
FROM ordered o JOIN acc a USING (i) JOIN stamps s USING (i) JOIN rr USING (i) JOIN rlist l USING (ridx)""",
    ["findings"], _G01_CTES))
def g01(spark, sf):
    valid = FD.split_valid(fixture(spark, sf, "findings"))[0]
    n = load_table(spark, sf, "documents").count()
    base = load_table(spark, sf, "events").agg(F.max("ts")).first()[0]
    repos = load_table(spark, sf, "documents").select(F.col("source").alias("repo"))
    out = SY.synthetic_reviews(valid, repos, n, base, seed=SEED)
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


@register("G01_mix_check", with_ctes("""
SELECT o.severity, a.accepted, count(*) AS n FROM ordered o JOIN acc a USING (i) GROUP BY ALL""",
    ["findings"], _G01_CTES))
def g01m(spark, sf):
    return g01(spark, sf).groupBy("severity", "accepted").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- S01, F16, F20, A21, X20



@register("S01_delivery_source", with_fixtures("""
SELECT delivery_id, event_name, strftime(received_ts, '%Y-%m-%dT%H:%M:%S.%f') AS received_ts,
       CAST(length(body) AS INT) AS body_chars FROM deliveries""", "deliveries"))
def s01(spark, sf):
    d = fixture(spark, sf, "deliveries")
    return d.select("delivery_id", "event_name", F.date_format("received_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("received_ts"),
                    F.length("body").alias("body_chars"))


def fault_injecting_reviewer_factory():
    """The rule reviewer, failing for every file of PRs whose number is a
    multiple of 7 (fault injection to exercise F20 / T07)."""
    base = U.rule_reviewer_factory()

    def review(prompt):
        if int(prompt["pr_number"]) % 7 == 0:
            raise TimeoutError("model timed out")
        return base(prompt)
    return review


def _enriched(spark, sf):
    return U.enrich(_prompts(spark, sf), ["repo", "pr_number", "filename"], fault_injecting_reviewer_factory,
                    retry_sleep=lambda s: None)


@register("F16_file_review_validation", with_fixtures("""
SELECT repo, pr_number, filename, pr_number % 7 <> 0 AS valid FROM diff_files WHERE coalesce(patch, '') <> ''""",
    "diff_files"))
def f16(spark, sf):
    e = _enriched(spark, sf)
    ok = F.col("filename").isNotNull() & F.col("summary").isNotNull() & F.col("has_issues").isNotNull()
    return e.select("repo", "pr_number", "filename", F.coalesce(ok, F.lit(False)).alias("valid"))


@register("F20_all_files_failed", with_fixtures("""
SELECT DISTINCT repo, pr_number FROM diff_files WHERE coalesce(patch, '') <> '' AND pr_number % 7 = 0""",
    "diff_files"))
def f20(spark, sf):
    e = _enriched(spark, sf)
    prs = e.select("repo", "pr_number").distinct()
    return FD.all_files_failed(prs, e.filter(F.col("error").isNull()))


@register("A21_load_counters", with_fixtures("""
SELECT count(*) AS read, CAST(count_if(trim(coalesce(rule, '')) = '') AS BIGINT) AS skipped,
       CAST(count_if(trim(coalesce(rule, '')) <> '') AS BIGINT) AS written FROM conventions""", "conventions"))
def a21(spark, sf):
    from revlens.sources.conventions_yaml import load_counters
    return load_counters(fixture(spark, sf, "conventions"))


def _x20_oracle():
    from revlens.plans.q_findings import _COUNTS_ALL
    from revlens import schemas as S
    from revlens import wording as W
    return with_fixtures(f"""
SELECT repo, pr_number,
       CASE WHEN critical > 0 THEN '#FF4444' WHEN high > 0 THEN '#FFB800' ELSE '#36A64F' END AS color,
       '{S.PRODUCT}, ' || repo || ', critical ' || critical || ', high ' || high || ', medium ' || medium || ', low ' || low || ', info ' || info AS fallback,
       CASE WHEN critical > 0 THEN '{W.CRITICAL_LINE}'
            WHEN high > 0 THEN '{W.HIGH_LINE}'
            ELSE '{W.CLEAR_LINE}' END AS verdict_text,
       'divider' AS third_block, '{W.NOTICE_TOTAL}' || (critical + high + medium + low + info) AS total_field,
       CASE WHEN critical = 0 AND high = 0 THEN 'primary' ELSE 'danger' END AS style,
       'https://example.invalid/' || repo || '/pull/' || pr_number AS url,
       '{W.NOTICE_WHERE[0]}' || repo || '{W.NOTICE_WHERE[1]}<https://example.invalid/' || repo || '/pull/' || pr_number || '|PR ' || pr_number || '>' AS header_text
FROM {_COUNTS_ALL}""", "findings", "reviewed_files")


@register("X20_notification_payloads", _x20_oracle())
def x20(spark, sf):
    """The JSON payload is built with to_json and read back field by field."""
    from revlens.operators.outputs import notification_payloads, notification_rows
    valid = FD.split_valid(fixture(spark, sf, "findings"))[0]
    prs = fixture(spark, sf, "reviewed_files")
    rows = notification_rows(FD.severity_counts_per_pr(valid, prs)).withColumn(
        "pr_url", F.concat(F.lit("https://example.invalid/"), F.col("repo"), F.lit("/pull/"), F.col("pr_number").cast("string"))
    ).withColumn("pr_title", F.concat(F.lit("PR "), F.col("pr_number").cast("string")))
    p = notification_payloads(rows)
    j = lambda path: F.get_json_object("payload", path)
    return p.select("repo", "pr_number", j("$.attachments[0].color").alias("color"),
                    j("$.attachments[0].fallback").alias("fallback"), j("$.blocks[3].text.text").alias("verdict_text"),
                    j("$.blocks[2].type").alias("third_block"), j("$.blocks[4].fields[5].text").alias("total_field"),
                    j("$.blocks[5].elements[0].style").alias("style"), j("$.blocks[5].elements[0].url").alias("url"),
                    j("$.blocks[1].text.text").alias("header_text"))
