"""Derived tables over the shared test tables.

Each derived table is one SQL template that runs unchanged on Spark and on
DuckDB (the oracle).  On Spark the base tables are bound as DataFrame
parameters (``spark.sql(text, documents=df)``), so no global temp views are
registered; on DuckDB the placeholders become the pre-registered view names.
Literal braces in the templates are doubled.

Deliveries are signed in Python (DuckDB has no HMAC) and landed as files once;
every job reads those files (see ``landed_deliveries``).
"""

from __future__ import annotations

import hmac
import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import scratch_path, spread
from revlens.sources import landing
from revlens.sources.samples import source_template
from revlens.sources.tables import load_table

TEMPLATES: dict[str, str] = {}

TEMPLATES["reviews"] = """
SELECT d.doc_id AS review_id, d.source AS repo,
       concat('f', d.doc_id % 7, '.py') AS file, CAST(1 + d.doc_id % 500 AS INT) AS line,
       CASE d.doc_id % 10 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'WARNING' ELSE 'SUGGESTION' END AS severity,
       CASE d.doc_id % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'logic' WHEN 3 THEN 'style' WHEN 4 THEN 'performance' ELSE 'test_coverage' END AS category,
       coalesce(l.quality, -1) AS accepted, e.ts AS ts,
       d.text AS comment, d.text AS code_snippet
FROM {documents} d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
LEFT JOIN {events} e ON e.event_id = d.doc_id
"""

TEMPLATES["conventions"] = """
SELECT b.item_id AS convention_id, b.text AS rule, e.embedding AS embedding,
       CASE WHEN b.item_id % 3 = 0 THEN '' ELSE concat('src', b.item_id % 20) END AS repo,
       CASE b.item_id % 4 WHEN 0 THEN '' WHEN 2 THEN 'javascript' ELSE 'python' END AS language,
       CASE b.item_id % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'python_style' WHEN 2 THEN 'error_handling' WHEN 3 THEN 'performance' ELSE 'testing' END AS category,
       'system' AS added_by
FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id
"""

TEMPLATES["review_vectors"] = """
SELECT vec_id AS review_id, concat('repo', label) AS repo, embedding,
       CASE vec_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'unknown' ELSE '' END AS language
FROM {embeddings}
"""

TEMPLATES["deliveries"] = """
SELECT delivery_id, received_ts, event_name, action, number, draft, repo, head_sha, additions,
       CASE WHEN delivery_id % 11 = 0 THEN '{{bad'
            ELSE concat('{{"action":"', action, '","number":', number,
                 ',"pull_request":{{"number":', number, ',"title":"PR ', number, '","state":"open","body":',
                 CASE delivery_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN concat('"  fixes ', number, chr(92), 'n', chr(92), 't"')
                      WHEN 3 THEN concat('"', repeat(concat('line ', delivery_id, chr(92), 'n'), 200), '"') ELSE concat('"see ', chr(92), 'u00e9 ', chr(92), '"x', chr(92), '" "') END,
                 ',"draft":',
                 CASE WHEN draft THEN 'true' ELSE 'false' END, ',"html_url":"u","user":{{"login":"dev","id":1}},"head":{{"label":"o:f","ref":"f","sha":"', upper(head_sha),
                 '"}},"base":{{"label":"o:main","ref":"main","sha":"', head_sha, '"}},"additions":', additions, '}}',
                 CASE WHEN delivery_id % 13 = 0 THEN '' ELSE concat(',"repository":{{"id":1,"name":"r","full_name":"', repo, '","html_url":"u","owner":{{"login":"org"}}}}') END,
                 ',"sender":{{"login":"dev","id":1}}}}') END AS body
FROM (SELECT event_id AS delivery_id, ts AS received_ts,
             CASE event_type WHEN 'error' THEN 'ping' WHEN 'signup' THEN 'issues' ELSE 'pull_request' END AS event_name,
             CASE event_id % 6 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'reopened' WHEN 3 THEN 'closed' WHEN 4 THEN 'labeled' ELSE 'edited' END AS action,
             user_id AS number, event_id % 7 = 0 AS draft, concat('org/repo', user_id % 10) AS repo,
             CASE WHEN event_id % 17 = 0 THEN 'abc' ELSE concat(md5(CAST(event_id AS STRING)), substring(md5(CAST(event_id AS STRING)), 1, 8)) END AS head_sha,
             CAST(floor(value) AS INT) AS additions
      FROM {events}) s
"""

TEMPLATES["diff_files"] = """
SELECT concat('org/repo', p_partkey % 5) AS repo, p_partkey % 40 AS pr_number, p_partkey AS file_id,
       concat('src.d/f', p_partkey, CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.tsx' WHEN 3 THEN '.css' WHEN 4 THEN '' WHEN 5 THEN '.PY' ELSE '.py' END) AS filename,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE
       concat('@@ -', p_partkey % 90 + 1, ',', p_size, ' +', p_partkey % 90 + 2,
              CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(',', p_size + 2) END, ' @@ ctx', chr(10),
              '+def f_', p_partkey, '(a, b):', chr(10), '+    return a', chr(10), '+', chr(10), '+   ', chr(10),
              '-old_', p_brand, chr(10), '--- dropped', chr(10), '+++i', chr(10), ' same', chr(10),
              '@@ -', p_size + 200, ' +', p_size + 201, ' @@', chr(10), '-x', chr(10)) END AS patch,
       'modified' AS status, 3 AS additions, 2 AS deletions
FROM {part}
"""

TEMPLATES["functions"] = """
SELECT p_partkey AS fn_id, p_partkey % 50 AS file_id, concat('f_', p_partkey) AS name,
       CAST(floor(p_partkey / 50) AS INT) * 10 AS start_line,
       CAST(floor(p_partkey / 50) AS INT) * 10 + p_size % 15 AS end_line,
       1 + p_size % 6 AS complexity, p_size % 2 = 0 AS has_docstring, p_size % 5 = 0 AS is_method
FROM {part}
"""

TEMPLATES["hunks"] = """
SELECT s_suppkey AS hunk_id, s_suppkey % 50 AS file_id, 1 + s_suppkey * 3 AS start, 1 + s_suppkey % 20 AS length
FROM {supplier}
"""

TEMPLATES["findings"] = """
SELECT o_orderkey AS finding_id, o_custkey AS pr_number, n_name AS repo,
       concat('f', o_orderkey % 4, '.py') AS filename, o_orderkey AS pos, CAST(o_orderkey % 500 AS INT) AS line,
       CASE WHEN o_orderkey % 97 = 0 THEN 'urgent' ELSE
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'info' END END AS severity,
       CASE o_orderkey % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'logic' WHEN 3 THEN 'style' WHEN 4 THEN 'performance' ELSE 'test_coverage' END AS category,
       CASE WHEN o_orderkey % 89 = 0 THEN 'bad' ELSE concat('issue number ', o_orderkey) END AS issue,
       concat('suggestion ', o_orderkey) AS suggestion,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('fix_', o_orderkey, '()') END AS code_fix, o_orderdate AS ts
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

TEMPLATES["reviewed_files"] = """
SELECT n_name AS repo, c_custkey AS pr_number, 'f0.py' AS filename
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION
SELECT n_name, o_custkey, concat('f', o_orderkey % 4, '.py')
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

TEMPLATES["feedback"] = """
SELECT event_id AS feedback_id, CASE WHEN event_id % 10 = 0 THEN -event_id ELSE event_id % 200 END AS review_id,
       CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS accepted, ts
FROM {events} WHERE event_type IN ('click', 'purchase', 'view')
"""

TEMPLATES["source_text"] = """
SELECT p_partkey AS file_id, 'python' AS language,
       concat('class C_', p_partkey, ':', chr(10),
              '    def run(self, a, b=1):', chr(10),
              CASE WHEN p_size % 2 = 0 THEN concat('        \"\"\"doc\"\"\"', chr(10)) ELSE concat('        # note', chr(10)) END,
              '        if a and b:', chr(10), '            return 1', chr(10),
              CASE WHEN p_size % 3 = 0 THEN concat('        for x in a:', chr(10), '            pass', chr(10)) ELSE '' END,
              '        def helper():', chr(10), '            return 2', chr(10), chr(10),
              'def top_', p_partkey, '(x, *args, **kw):', chr(10), '    return x') AS source
FROM {part}
"""

TEMPLATES["code_samples"] = source_template()

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def base_tables(name: str) -> list[str]:
    """Names of the base tables a template reads."""
    return sorted(set(_PLACEHOLDER.findall(TEMPLATES[name])))


def duckdb_sql(name: str) -> str:
    """The template rendered for DuckDB (views carry the table names)."""
    names = {t: t for t in base_tables(name)}
    return TEMPLATES[name].format(**names)


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the derived tables it needs as CTEs."""
    ctes = ",\n".join(f"{n} AS ({duckdb_sql(n)})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql


# Test secret for signed deliveries; rows with delivery_id % 9 = 0 are signed
# with a different key so their signature must fail.
TEST_WEBHOOK_SECRET = "test-webhook-secret"
_WRONG_SECRET = "not-the-secret"


def _sign_batches(it):
    """Sign bodies with Python's hmac (independent of the native check)."""
    good = TEST_WEBHOOK_SECRET.encode()
    bad = _WRONG_SECRET.encode()
    for pdf in it:
        pdf["signature"] = [
            "sha256=" + hmac.new(bad if int(did) % 9 == 0 else good,
                                 body.encode("utf-8"), hashlib.sha256).hexdigest()
            for did, body in zip(pdf["delivery_id"], pdf["body"])]
        yield pdf


_LANDED: dict[tuple[str, str], str] = {}


def landed_deliveries(spark: SparkSession, sf_dir: str) -> str:
    """Folder of landed files made of the events: signed deliveries, and lines cut off in the middle of a record.

    Written once per application and directory; jobs read the files only.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        path = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
        # the events are spread, not the bodies made of them
        events = spread(load_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
        df = spark.sql(TEMPLATES["deliveries"], events=events)
        signed = df.mapInPandas(_sign_batches, T.StructType(df.schema.fields + [T.StructField("signature", T.StringType())]))
        landing.land(signed, f"{path}/deliveries")
        cut_off = load_table(spark, sf_dir, "events").filter("event_id % 50 = 0")
        cut_off.select(F.concat(F.lit('{"delivery_id":"x'), F.col("event_id").cast("string"), F.lit('","body":"{'))).write.option("compression", "gzip").text(f"{path}/cut-off")
        _LANDED[key] = path
    return _LANDED[key]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived table on Spark from the shared parquet tables; deliveries are read from their landed files."""
    if name == "deliveries":
        return landing.good(landing.read_landed(spark, landed_deliveries(spark, sf_dir))).withColumn(
            "delivery_id", F.col("delivery_id").cast("long"))
    params = {t: load_table(spark, sf_dir, t) for t in base_tables(name)}
    return spark.sql(TEMPLATES[name], **params)


def with_ctes(sql: str, fixtures: list[str], extra: list[tuple[str, str]]) -> str:
    """Oracle query with derived tables and further named CTEs."""
    parts = [f"{n} AS ({duckdb_sql(n)})" for n in fixtures] + [f"{n} AS ({q})" for n, q in extra]
    return "WITH " + ",\n".join(parts) + "\n" + sql
