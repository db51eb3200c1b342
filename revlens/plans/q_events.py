"""Registered webhook-delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import wording as W
from revlens.catalog import register
from revlens.operators import diffs as D
from revlens.operators import events as E
from revlens.plans.sql import with_fixtures
from revlens.sources.fixtures import TEST_WEBHOOK_SECRET, fixture

# Oracle spellings: required JSON paths and the ordered disposition.
_REQ = ["action", "number", "pull_request.number", "pull_request.title", "pull_request.state",
        "pull_request.html_url", "pull_request.user.login", "pull_request.user.id",
        "pull_request.head.label", "pull_request.head.ref", "pull_request.head.sha",
        "pull_request.base.label", "pull_request.base.ref", "pull_request.base.sha",
        "repository.id", "repository.name", "repository.full_name", "repository.html_url",
        "repository.owner.login", "sender.login", "sender.id"]
_MISSING = " OR ".join(f"coalesce(json_type(body, '$.{p}'), 'NULL') = 'NULL'" for p in _REQ)
_SCHEMA_BAD = (f"({_MISSING} OR length(json_extract_string(body, '$.pull_request.head.sha')) < 7 "
               f"OR length(json_extract_string(body, '$.pull_request.base.sha')) < 7)")
_ACTION = "json_extract_string(body, '$.action')"
_DRAFT = "coalesce(CAST(json_extract(body, '$.pull_request.draft') AS BOOLEAN), false)"
_DISPOSITION = f"""
  CASE WHEN delivery_id % 9 = 0 THEN 'rejected' WHEN event_name = 'ping' THEN 'ok'
       WHEN event_name <> 'pull_request' THEN 'ignored' WHEN NOT json_valid(body) THEN 'rejected'
       WHEN {_SCHEMA_BAD} THEN 'rejected'
       WHEN {_ACTION} NOT IN ('opened', 'synchronize', 'reopened') THEN 'ignored'
       WHEN {_DRAFT} THEN 'ignored' ELSE 'queued' END AS status,
  CAST(CASE WHEN delivery_id % 9 = 0 THEN 401 WHEN event_name = 'ping' THEN 200
       WHEN event_name <> 'pull_request' THEN 200 WHEN NOT json_valid(body) THEN 400
       WHEN {_SCHEMA_BAD} THEN 422 ELSE 200 END AS INT) AS http_code"""


def routed(spark, sf):
    return E.route(fixture(spark, sf, "deliveries"), TEST_WEBHOOK_SECRET)


ORACLE_F04 = with_fixtures(f"SELECT delivery_id, {_DISPOSITION} FROM deliveries", "deliveries")
ORACLE_DELIVERY_IDS = with_fixtures("SELECT delivery_id FROM deliveries", "deliveries")
ORACLE_REJECTED = with_fixtures(
    f"SELECT delivery_id, http_code FROM (SELECT delivery_id, {_DISPOSITION} FROM deliveries) WHERE status = 'rejected'",
    "deliveries")


@register("F04_delivery_disposition", ORACLE_F04)
def f04(spark, sf):
    return routed(spark, sf).select("delivery_id", "status", "http_code")


@register("F04_disposition_counts", with_fixtures(
    f"SELECT status, http_code, count(*) AS n FROM (SELECT {_DISPOSITION} FROM deliveries) GROUP BY ALL",
    "deliveries"))
def f04c(spark, sf):
    return routed(spark, sf).groupBy("status", "http_code").agg(F.count(F.lit(1)).alias("n"))


@register("F05_signature_check", with_fixtures(
    "SELECT delivery_id, delivery_id % 9 <> 0 AS signature_ok FROM deliveries", "deliveries"))
def f05(spark, sf):
    code, _ = E.signature_check(TEST_WEBHOOK_SECRET)
    return fixture(spark, sf, "deliveries").select("delivery_id", code.isNull().alias("signature_ok"))


@register("F01_event_routing", with_fixtures("""
SELECT delivery_id, CASE WHEN coalesce(event_name, 'unknown') = 'ping' THEN 'ok'
                         WHEN coalesce(event_name, 'unknown') <> 'pull_request' THEN 'ignored'
                         ELSE 'continue' END AS route FROM deliveries""", "deliveries"))
def f01(spark, sf):
    ev = F.coalesce(F.col("event_name"), F.lit("unknown"))
    return fixture(spark, sf, "deliveries").select(
        "delivery_id", F.when(ev == "ping", "ok").when(ev != "pull_request", "ignored")
        .otherwise("continue").alias("route"))


@register("F02_F03_reviewable_non_draft", with_fixtures(f"""
SELECT delivery_id, {_ACTION} AS action FROM deliveries
WHERE json_valid(body) AND NOT {_SCHEMA_BAD} AND {_ACTION} IN ('opened', 'synchronize', 'reopened') AND NOT {_DRAFT}""",
    "deliveries"))
def f02(spark, sf):
    p = E.parse_event(fixture(spark, sf, "deliveries")).filter("schema_ok")
    return (p.filter(F.col("event.action").isin("opened", "synchronize", "reopened"))
            .filter(~F.col("event.pull_request.draft"))
            .select("delivery_id", F.col("event.action").alias("action")))


@register("S02_typed_event_parse", with_fixtures(f"""
SELECT delivery_id, json_valid(body) AS json_ok,
       CASE WHEN json_valid(body) THEN NOT {_SCHEMA_BAD} ELSE false END AS schema_ok FROM deliveries""",
    "deliveries"))
def s02(spark, sf):
    return E.parse_event(fixture(spark, sf, "deliveries")).select(
        "delivery_id", "json_ok", F.coalesce("schema_ok", F.lit(False)).alias("schema_ok"))


@register("S02_event_fields", with_fixtures(f"""
SELECT delivery_id, {_ACTION} AS action, CAST(json_extract(body, '$.number') AS BIGINT) AS number,
       json_extract_string(body, '$.pull_request.title') AS title,
       json_extract_string(body, '$.repository.full_name') AS repo,
       lower(json_extract_string(body, '$.pull_request.head.sha')) AS head_sha,
       {_DRAFT} AS draft, CAST(json_extract(body, '$.pull_request.additions') AS BIGINT) AS additions,
       coalesce(CAST(json_extract(body, '$.pull_request.deletions') AS BIGINT), 0) AS deletions,
       coalesce(json_extract_string(body, '$.repository.default_branch'), 'main') AS default_branch,
       coalesce(json_extract_string(body, '$.pull_request.user.type'), 'User') AS user_type,
       coalesce(CAST(json_extract(body, '$.repository.owner.id') AS BIGINT), 0) AS owner_id
FROM deliveries WHERE json_valid(body) AND NOT {_SCHEMA_BAD}""", "deliveries"))
def s02f(spark, sf):
    p = E.parse_event(fixture(spark, sf, "deliveries")).filter("schema_ok")
    return p.select("delivery_id", F.col("event.action").alias("action"), F.col("event.number").alias("number"),
                    F.col("event.pull_request.title").alias("title"),
                    F.col("event.repository.full_name").alias("repo"),
                    F.col("event.pull_request.head.sha").alias("head_sha"),
                    F.col("event.pull_request.draft").alias("draft"),
                    F.col("event.pull_request.additions").alias("additions"),
                    F.col("event.pull_request.deletions").alias("deletions"),
                    F.col("event.repository.default_branch").alias("default_branch"),
                    F.col("event.pull_request.user.type").alias("user_type"),
                    F.col("event.repository.owner.id").alias("owner_id"))


@register("F06_sha_check", with_fixtures(f"""
SELECT delivery_id, length(json_extract_string(body, '$.pull_request.head.sha')) >= 7
                    AND length(json_extract_string(body, '$.pull_request.base.sha')) >= 7 AS sha_ok
FROM deliveries WHERE json_valid(body) AND json_extract_string(body, '$.pull_request.head.sha') IS NOT NULL
  AND json_extract_string(body, '$.pull_request.base.sha') IS NOT NULL""", "deliveries"))
def f06(spark, sf):
    p = E.parse_event(fixture(spark, sf, "deliveries")).filter("json_ok")
    head, base = F.col("event.pull_request.head.sha"), F.col("event.pull_request.base.sha")
    return (p.filter(head.isNotNull() & base.isNotNull())
            .select("delivery_id", (E.sha_ok(head) & E.sha_ok(base)).alias("sha_ok")))


_QUEUED = f"SELECT * FROM deliveries WHERE {_DISPOSITION.split(' AS status')[0]} = 'queued'"


# the description without spaces at its ends, and the id that a delivery's review gets
_BODY = r"substring(regexp_replace(coalesce(json_extract_string(body, '$.pull_request.body'), ''), '^\s+|\s+$', '', 'g'), 1, 1000)"
_SHA = "sha256('review:' || delivery_id)"
_REVIEW_ID = (f"substring({_SHA}, 1, 8) || '-' || substring({_SHA}, 9, 4) || '-' || substring({_SHA}, 13, 4) || '-' || "
              f"substring({_SHA}, 17, 4) || '-' || substring({_SHA}, 21, 12)")


@register("X30_pr_context", with_fixtures(f"""
SELECT delivery_id AS event_id, CAST(json_extract(body, '$.pull_request.number') AS BIGINT) AS pr_number,
       json_extract_string(body, '$.pull_request.title') AS pr_title, {_BODY} AS pr_body,
       {_REVIEW_ID} AS review_id, json_extract_string(body, '$.pull_request.user.login') AS author, {_DRAFT} AS is_draft,
       json_extract_string(body, '$.repository.full_name') AS repo_full_name,
       substring(lower(json_extract_string(body, '$.pull_request.head.sha')), 1, 12) AS head_sha12,
       substring(lower(json_extract_string(body, '$.pull_request.base.sha')), 1, 12) AS base_sha12,
       {_ACTION} AS action
FROM ({_QUEUED})""", "deliveries"))
def x30(spark, sf):
    ctx = E.pr_context(routed(spark, sf))
    lx = E.log_extra(ctx)
    return ctx.select("event_id", "pr_number", "pr_title", "pr_body", "repo_full_name",
                      lx["review_id"].alias("review_id"), lx["author"].alias("author"), lx["is_draft"].alias("is_draft"),
                      lx["head_sha"].alias("head_sha12"), lx["base_sha"].alias("base_sha12"), lx["action"].alias("action"))


_PR_TITLES = f"""SELECT json_extract_string(body, '$.repository.full_name') AS repo,
       CAST(json_extract(body, '$.pull_request.number') AS BIGINT) AS pr_number,
       arg_max(json_extract_string(body, '$.pull_request.title'), received_ts) AS title,
       arg_max({_BODY}, received_ts) AS body
FROM ({_QUEUED}) GROUP BY 1, 2"""


def pr_titles(spark, sf):
    """Latest title/body per (repo, PR) from queued deliveries."""
    ctx = E.pr_context(routed(spark, sf), keep=("received_ts",))
    return (ctx.groupBy(F.col("repo_full_name").alias("repo"), "pr_number")
            .agg(F.max_by("pr_title", "received_ts").alias("title"), F.max_by("pr_body", "received_ts").alias("body")))


@register("S05_pr_metadata", with_fixtures(_PR_TITLES, "deliveries"))
def s05(spark, sf):
    return pr_titles(spark, sf)


@register("S04_files_with_title", with_fixtures(f"""
SELECT d.repo, d.pr_number, d.file_id, d.filename, t.title
FROM diff_files d JOIN ({_PR_TITLES}) t ON d.repo = t.repo AND d.pr_number = t.pr_number
WHERE coalesce(d.patch, '') <> ''""", "deliveries", "diff_files"))
def s04(spark, sf):
    files = D.with_patch(fixture(spark, sf, "diff_files"))
    return files.join(pr_titles(spark, sf), ["repo", "pr_number"]).select(
        "repo", "pr_number", "file_id", "filename", "title")


@register("F19_nothing_reviewable", with_fixtures(f"""
SELECT t.repo, t.pr_number, '{W.NO_FILES}' AS message
FROM ({_PR_TITLES}) t
WHERE NOT EXISTS (SELECT 1 FROM diff_files d WHERE d.repo = t.repo AND d.pr_number = t.pr_number
                  AND coalesce(d.patch, '') <> '')""", "deliveries", "diff_files"))
def f19(spark, sf):
    from revlens.operators.findings import nothing_reviewable
    prs = pr_titles(spark, sf).select("repo", "pr_number")
    return nothing_reviewable(prs, D.changed_files(fixture(spark, sf, "diff_files")))
