"""Registered findings, verdict and output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import schemas as S
from revlens import wording as W
from revlens.catalog import register
from revlens.functions.lookups import verdict_display
from revlens.operators import findings as FD
from revlens.plans.sql import with_fixtures
from revlens.sources.fixtures import fixture

P = S.PRODUCT
NL = "chr(10)"
_ICON = ("CASE severity WHEN 'critical' THEN '🚨' WHEN 'high' THEN '❗' WHEN 'medium' THEN '⚠️' "
         "WHEN 'low' THEN '💡' WHEN 'info' THEN 'ℹ️' ELSE '•' END")
_VALID = ("coalesce(line >= 1, false) AND coalesce(severity IN ('critical','high','medium','low','info'), false) "
          "AND coalesce(category IN ('security','bug','logic','style','performance','test_coverage'), false) "
          "AND coalesce(length(issue) >= 5, false) AND coalesce(length(suggestion) >= 5, false)")
_VF = f"(SELECT * FROM findings WHERE {_VALID})"
# file reviews: one row per file with the stand-in summary
_FR = f"""(SELECT repo, pr_number, filename, count(*) AS n,
        filename || ': ' || count(*) || ' finding(s).' AS summary,
        min(pos) AS first_pos, arg_min(category, pos) AS first_category,
        min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 END) AS worst,
        bool_or(severity = 'critical') AS any_critical
   FROM {_VF} GROUP BY repo, pr_number, filename)"""
# all reviewed files, clean ones included
_FRC = f"""(SELECT f.repo, f.pr_number, f.filename, count(v.pos) AS n,
        f.filename || ': ' || count(v.pos) || ' finding(s).' AS summary
   FROM reviewed_files f LEFT JOIN {_VF} v USING (repo, pr_number, filename) GROUP BY f.repo, f.pr_number, f.filename)"""
_FIX_MD = f"CASE WHEN coalesce(code_fix, '') <> '' THEN '```' || {NL} || code_fix || {NL} || '```' END"
_X26_ITEM = (f"'* ' || line || ', ' || severity || ', ' || category || ': ' || issue || '{W.TEXT_PROPOSAL}' || suggestion || "
             f"CASE WHEN coalesce(code_fix, '') <> '' THEN '{W.TEXT_FIX}' || code_fix ELSE '' END")
_TITLE = f"'{W.FILE_TITLE[0]}' || {{}}.filename || '{W.FILE_TITLE[1]}'"
_X26 = f"""(SELECT f.repo, f.pr_number, f.filename,
        concat_ws({NL}, '{W.TEXT_FILE}' || f.filename, r.summary, string_agg({_X26_ITEM}, {NL} ORDER BY pos)) AS text
   FROM {_VF} f JOIN {_FR} r USING (repo, pr_number, filename) GROUP BY f.repo, f.pr_number, f.filename, r.summary)"""


def valid_findings(spark, sf):
    return FD.split_valid(fixture(spark, sf, "findings"))[0]


def reviews(spark, sf):
    return FD.file_reviews(valid_findings(spark, sf))


def all_reviews(spark, sf):
    """File reviews of all reviewed files, clean ones included."""
    return FD.file_reviews(valid_findings(spark, sf), files=fixture(spark, sf, "reviewed_files"))


def all_counts(spark, sf):
    return FD.severity_counts_per_pr(valid_findings(spark, sf), fixture(spark, sf, "reviewed_files"))


@register("F15_finding_validation", with_fixtures("""
SELECT finding_id, coalesce(line >= 1, false) AND coalesce(severity IN ('critical','high','medium','low','info'), false)
         AND coalesce(category IN ('security','bug','logic','style','performance','test_coverage'), false)
         AND coalesce(length(issue) >= 5, false) AND coalesce(length(suggestion) >= 5, false) AS valid,
       concat_ws(',', CASE WHEN NOT coalesce(line >= 1, false) THEN 'line>=1' END,
                 CASE WHEN NOT coalesce(severity IN ('critical','high','medium','low','info'), false) THEN 'severity' END,
                 CASE WHEN NOT coalesce(category IN ('security','bug','logic','style','performance','test_coverage'), false) THEN 'category' END,
                 CASE WHEN NOT coalesce(length(issue) >= 5, false) THEN 'issue>=5' END,
                 CASE WHEN NOT coalesce(length(suggestion) >= 5, false) THEN 'suggestion>=5' END) AS failed_rules
FROM findings""", "findings"))
def f15(spark, sf):
    v = FD.validate_findings(fixture(spark, sf, "findings"))
    return v.select("finding_id", "valid", F.array_join("failed_rules", ",").alias("failed_rules"))


@register("F18_known_severity_counts", with_fixtures("""
SELECT severity, count(*) AS n FROM findings WHERE severity IN ('critical','high','medium','low','info') GROUP BY 1""",
    "findings"))
def f18(spark, sf):
    return FD.known_severity(fixture(spark, sf, "findings")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@register("A11_A13_A22_file_rollup", with_fixtures(f"""
SELECT repo, pr_number, filename, CAST(n AS INT) AS n_comments,
       CASE worst WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'SUGGESTION' END AS stored_severity,
       coalesce(first_category, 'general') AS stored_category,
       CASE WHEN any_critical THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS review_event
FROM {_FR}""", "findings"))
def a11(spark, sf):
    return FD.file_rollup(valid_findings(spark, sf))


@register("A11_pr_worst_severity", with_fixtures(f"""
SELECT repo, pr_number, CASE min(worst) WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'SUGGESTION' END AS stored_severity
FROM {_FR} GROUP BY repo, pr_number""", "findings"))
def a11p(spark, sf):
    from revlens.functions.lookups import severity_rank, stored_severity_from_rank
    v = valid_findings(spark, sf)
    return (v.groupBy(*FD.PR_KEYS).agg(F.min(severity_rank("severity")).alias("w"))
            .select(*FD.PR_KEYS, stored_severity_from_rank(F.col("w")).alias("stored_severity")))


@register("O01_findings_by_line", with_fixtures(f"""
SELECT repo, pr_number, filename, pos, CAST(row_number() OVER (PARTITION BY repo, pr_number, filename ORDER BY line, pos) AS INT) AS display_order
FROM {_VF}""", "findings"))
def o01(spark, sf):
    r = reviews(spark, sf)
    return (r.select(*FD.FILE_KEYS, F.posexplode(FD.by_line(F.col("comments"))).alias("i", "c"))
            .select(*FD.FILE_KEYS, F.col("c.pos").alias("pos"), (F.col("i") + 1).alias("display_order")))


@register("X25_file_comment_markdown", with_fixtures(f"""
SELECT r.repo, r.pr_number, r.filename,
       concat_ws({NL} || {NL}, {_TITLE.format('r')}, r.summary,
                 CASE WHEN r.n = 0 THEN '{W.NOTHING_FOUND}' ELSE string_agg(concat_ws({NL}, '* ' || {_ICON} || ' line ' || line || ', ' || severity || ', ' || category || ': ' || issue,
                                      '{W.PROPOSAL}' || suggestion, {_FIX_MD}), {NL} ORDER BY line, pos) END,
                 '{W.FILE_END}') AS body
FROM {_FRC} r LEFT JOIN {_VF} f USING (repo, pr_number, filename)
GROUP BY r.repo, r.pr_number, r.filename, r.summary, r.n""", "findings", "reviewed_files"))
def x25(spark, sf):
    r = all_reviews(spark, sf)
    return r.select(*FD.FILE_KEYS, FD.file_comment_markdown(r).alias("body"))


@register("X26_file_review_text", with_fixtures(f"SELECT * FROM {_X26}", "findings"))
def x26(spark, sf):
    r = reviews(spark, sf)
    return r.select(*FD.FILE_KEYS, FD.file_review_text(r).alias("text"))


@register("X24_S16_inline_comments", with_fixtures(f"""
SELECT f.repo, f.pr_number, f.filename, f.pos, f.filename AS path, f.line, 'RIGHT' AS side,
       concat_ws({NL} || {NL}, {_ICON} || ' ' || severity || ', ' || category || ': ' || issue, '{W.PROPOSAL}' || suggestion, {_FIX_MD}) AS body,
       CASE WHEN r.any_critical THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event,
       {_TITLE.format('f')} || {NL} || {NL} || r.summary AS review_body
FROM {_VF} f JOIN {_FR} r USING (repo, pr_number, filename)""", "findings"))
def x24(spark, sf):
    from revlens.operators.outputs import inline_comment_rows
    return inline_comment_rows(reviews(spark, sf))


_COUNTS = f"""(SELECT repo, pr_number,
   CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'high') AS BIGINT) AS high,
   CAST(count_if(severity = 'medium') AS BIGINT) AS medium, CAST(count_if(severity = 'low') AS BIGINT) AS low,
   CAST(count_if(severity = 'info') AS BIGINT) AS info
 FROM {_VF} GROUP BY repo, pr_number)"""
_COUNTS_ALL = f"""(SELECT p.repo, p.pr_number,
   CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'high') AS BIGINT) AS high,
   CAST(count_if(severity = 'medium') AS BIGINT) AS medium, CAST(count_if(severity = 'low') AS BIGINT) AS low,
   CAST(count_if(severity = 'info') AS BIGINT) AS info
 FROM (SELECT DISTINCT repo, pr_number FROM reviewed_files) p LEFT JOIN {_VF} v USING (repo, pr_number) GROUP BY p.repo, p.pr_number)"""
_TABLE = f"""CASE WHEN greatest(critical, high, medium, low, info) > 0 THEN concat_ws({NL}, '| Severity | Count |', '|----------|-------|',
   CASE WHEN critical > 0 THEN '| 🚨 Critical | ' || critical || ' |' END, CASE WHEN high > 0 THEN '| ❗ High | ' || high || ' |' END,
   CASE WHEN medium > 0 THEN '| ⚠️ Medium | ' || medium || ' |' END, CASE WHEN low > 0 THEN '| 💡 Low | ' || low || ' |' END,
   CASE WHEN info > 0 THEN '| ℹ️ Info | ' || info || ' |' END) END"""


@register("A12_severity_table", with_fixtures(f"SELECT repo, pr_number, {_TABLE} AS severity_table FROM {_COUNTS}",
                                              "findings"))
def a12(spark, sf):
    c = FD.severity_counts_per_pr(valid_findings(spark, sf))
    return c.select(*FD.PR_KEYS, FD.severity_table(c).alias("severity_table"))


_ROLLUP = f"""(SELECT repo, pr_number, count(*) AS files_reviewed, CAST(sum(n) AS BIGINT) AS total_issues,
    bool_or(n > 0) AS any_issues,
    concat_ws({NL} || {NL}, '{W.SUMMARY_TITLE}', CASE WHEN sum(n) > 0 THEN '{W.WITH_FINDINGS}' ELSE '{W.WITHOUT_FINDINGS}' END,
              string_agg('* `' || filename || '` (' || n || '): ' || summary, {NL} ORDER BY filename), '{W.SUMMARY_END}') AS fallback_summary
  FROM {_FR} GROUP BY repo, pr_number)"""
_ROLLUP_ALL = _ROLLUP.replace(_FR, _FRC)


@register("A14_A15_A18_J08_pr_rollup", with_fixtures(f"""
SELECT repo, pr_number, files_reviewed, total_issues, any_issues,
       CASE WHEN any_issues THEN 'needs_changes' ELSE 'approved' END AS fallback_verdict,
       CASE WHEN any_issues THEN '⚠️ NEEDS CHANGES' ELSE '✅ APPROVED' END AS verdict_display,
       fallback_summary FROM {_ROLLUP_ALL}""", "findings", "reviewed_files"))
def a14(spark, sf):
    p = FD.pr_rollup(all_reviews(spark, sf))
    return p.select(*FD.PR_KEYS, "files_reviewed", "total_issues", "any_issues", "fallback_verdict",
                    verdict_display("fallback_verdict").alias("verdict_display"), "fallback_summary")


@register("A17_findings_text", with_fixtures(f"""
SELECT repo, pr_number, string_agg(text, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY filename) AS findings_text
FROM {_X26} GROUP BY repo, pr_number""", "findings"))
def a17(spark, sf):
    return FD.findings_text(reviews(spark, sf))


@register("A17_findings_text_budget", with_fixtures(f"""
SELECT repo, pr_number, substring(string_agg(text, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY filename), 1, 1500) AS findings_text
FROM {_X26} GROUP BY repo, pr_number""", "findings"))
def a17_budget(spark, sf):
    """With a caller's own budget of characters."""
    return FD.findings_text(reviews(spark, sf), max_chars=1500)


@register("S17_pr_summary_outbox", with_fixtures(f"""
SELECT c.repo, c.pr_number, concat_ws({NL} || {NL}, {_TABLE}, r.fallback_summary) AS body
FROM {_COUNTS_ALL} c JOIN {_ROLLUP_ALL} r USING (repo, pr_number)""", "findings", "reviewed_files"))
def s17(spark, sf):
    from revlens.operators.outputs import pr_summary_rows
    return pr_summary_rows(all_counts(spark, sf), FD.pr_rollup(all_reviews(spark, sf)))


@register("S18_file_comment_outbox", with_fixtures(f"""
SELECT r.repo, r.pr_number, r.filename, 'COMMENT' AS event,
       md5(concat_ws({NL} || {NL}, {_TITLE.format('r')}, r.summary,
                 CASE WHEN r.n = 0 THEN '{W.NOTHING_FOUND}' ELSE string_agg(concat_ws({NL}, '* ' || {_ICON} || ' line ' || line || ', ' || severity || ', ' || category || ': ' || issue,
                                      '{W.PROPOSAL}' || suggestion, {_FIX_MD}), {NL} ORDER BY line, pos) END,
                 '{W.FILE_END}')) AS body_md5
FROM {_FRC} r LEFT JOIN {_VF} f USING (repo, pr_number, filename)
GROUP BY r.repo, r.pr_number, r.filename, r.summary, r.n""", "findings", "reviewed_files"))
def s18(spark, sf):
    from revlens.operators.outputs import file_comment_rows
    rows = file_comment_rows(all_reviews(spark, sf))
    return rows.select(*FD.FILE_KEYS, "event", F.md5("body").alias("body_md5"))


@register("A16_S19_notification", with_fixtures(f"""
SELECT repo, pr_number, critical, high, medium, low, info,
       CASE WHEN critical > 0 THEN '#FF4444' WHEN high > 0 THEN '#FFB800' ELSE '#36A64F' END AS colour,
       CASE WHEN critical > 0 THEN '{W.CRITICAL_LINE}'
            WHEN high > 0 THEN '{W.HIGH_LINE}'
            ELSE '{W.CLEAR_LINE}' END AS verdict_text,
       critical + high + medium + low + info AS total,
       CASE WHEN critical = 0 AND high = 0 THEN 'primary' ELSE 'danger' END AS button_style,
       '{P}, ' || repo || ', critical ' || critical || ', high ' || high || ', medium ' || medium || ', low ' || low || ', info ' || info AS fallback
FROM {_COUNTS_ALL}""", "findings", "reviewed_files"))
def a16(spark, sf):
    from revlens.operators.outputs import notification_rows
    n = notification_rows(all_counts(spark, sf))
    return n.select(*FD.PR_KEYS, *S.SEVERITY_ORDER, "colour", "verdict_text", "total", "button_style", "fallback")


@register("O05_severity_order", with_fixtures("""
SELECT severity, CAST(list_position(['critical','high','medium','low','info'], severity) AS INT) AS severity_order, count(*) AS n
FROM findings WHERE severity IN ('critical','high','medium','low','info') GROUP BY severity""", "findings"))
def o05(spark, sf):
    order = F.array(*[F.lit(s) for s in S.SEVERITY_ORDER])
    f = FD.known_severity(fixture(spark, sf, "findings"))
    return (f.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
            .select("severity", F.array_position(order, F.col("severity")).cast("int").alias("severity_order"), "n")
            .orderBy("severity_order"))


@register("J10_zip_arrays", with_fixtures(f"""
SELECT repo, pr_number, filename, line, severity FROM {_VF}""", "findings"))
def j10(spark, sf):
    r = reviews(spark, sf)
    z = r.select(*FD.FILE_KEYS, F.transform("comments", lambda c: c["line"]).alias("lines"),
                 F.transform("comments", lambda c: c["severity"]).alias("sevs"))
    return z.select(*FD.FILE_KEYS, F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("sevs").alias("severity"))))
