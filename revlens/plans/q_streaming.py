"""Registered streaming queries: each runs its Structured Streaming job over
the landing files with the availableNow trigger and returns the sink's
table; the oracle is the batch answer to the same question."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revlens.catalog import register
from revlens.plans import q_events, q_feedback, q_metrics
from revlens.plans.sql import with_fixtures
from revlens.session import scratch_path
from revlens.sources import landing, sinks
from revlens.sources.fixtures import TEST_WEBHOOK_SECRET, fixture, landed_deliveries
from revlens.sources.tables import table_path
from revlens.streaming import jobs as J


@register("T01_T02_stream_routing", q_events.ORACLE_F04)
def t01(spark, sf):
    path = J.ingest_and_route(spark, landed_deliveries(spark, sf), TEST_WEBHOOK_SECRET)
    return spark.read.parquet(path).select("delivery_id", "status", "http_code")


@register("T03_dedupe_redeliveries", q_events.ORACLE_DELIVERY_IDS)
def t03(spark, sf):
    """Every delivery lands twice, the second time in files of its own."""
    twice = scratch_path(spark, f"twice-{uuid.uuid4().hex}")
    rows = landing.good(landing.read_landed(spark, landed_deliveries(spark, sf)))
    landing.land(rows, f"{twice}/first")
    landing.land(rows, f"{twice}/again")
    return spark.read.parquet(J.run_dedupe(spark, twice)).select("delivery_id")


@register("T04_issues_per_day_stream", q_metrics.ORACLE_A06)
def t04(spark, sf):
    _, base = J.run_gold(spark, J.issues_per_day_stream(J.reviews_stream(spark, sf)), "issues_per_day", ["date"], J.day_bucket())
    return sinks.read_keyed(spark, base)


@register("T05_running_repo_breakdown", q_metrics.ORACLE_A05)
def t05(spark, sf):
    _, base = J.run_gold(spark, J.running_repo_breakdown(J.reviews_stream(spark, sf)), "repo_breakdown", ["repo"], J.repo_bucket())
    return sinks.read_keyed(spark, base)


@register("T08_gold_refresh", q_metrics.ORACLE_A05)
def t08(spark, sf):
    """The refreshing query of the dashboard's table, stopped when it has read all that is there."""
    q, base = J.run_gold(spark, J.running_repo_breakdown(J.reviews_stream(spark, sf)), "repo_gold", ["repo"], J.repo_bucket(),
                         trigger=J.GOLD_REFRESH)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sinks.read_keyed(spark, base)


@register("T06_incremental_feedback", q_feedback.ORACLE_J05)
def t06(spark, sf):
    base = J.incremental_feedback(spark, fixture(spark, sf, "reviews"),
                                  J.feedback_stream(spark, table_path(sf, "events")))
    return J.current_reviews(spark, base).select("review_id", "repo", "accepted")


@register("T06_compacted_feedback", q_feedback.ORACLE_J05)
def t06c(spark, sf):
    """The same after the log is folded into the next snapshot."""
    base = J.incremental_feedback(spark, fixture(spark, sf, "reviews"),
                                  J.feedback_stream(spark, table_path(sf, "events")))
    J.compact(spark, base)
    return J.current_reviews(spark, base).select("review_id", "repo", "accepted")


_CUT_OFF = "SELECT NULL AS delivery_id, 400 AS http_code FROM events WHERE event_id % 50 = 0"


@register("T07_dead_letters", q_events.ORACLE_REJECTED + f" UNION ALL {_CUT_OFF}")
def t07(spark, sf):
    _ok, dead = J.route_with_dead_letters(spark, landed_deliveries(spark, sf), TEST_WEBHOOK_SECRET)
    return spark.read.parquet(dead).select("delivery_id", "http_code")


@register("S01_landed_dead_lines", """
SELECT '{"delivery_id":"x' || event_id || '","body":"{' AS line, 'not a delivery record' AS reason FROM events WHERE event_id % 50 = 0""")
def s01_dead(spark, sf):
    """Landed lines that are no delivery, with the reason."""
    return landing.bad_lines(landing.read_landed(spark, landed_deliveries(spark, sf))).select("line", "reason")


# a run per pull request: its files end well or not, some never report
_OK = "file_id % 3 <> 0 AND pr_number % 5 <> 0"
_REPORTS = "NOT (pr_number % 7 = 0 AND file_id % 2 = 0)"


@register("T07_pr_alerts", with_fixtures(f"""
SELECT repo || '/' || pr_number AS run, repo, pr_number,
       CASE WHEN count_if({_REPORTS}) < count(*) THEN 'not finished' ELSE 'all files failed' END AS reason,
       CAST(count(*) AS INT) AS files, CAST(count_if({_REPORTS} AND NOT ({_OK})) AS INT) AS failed
FROM diff_files GROUP BY repo, pr_number
HAVING count_if({_REPORTS}) < count(*) OR count_if({_REPORTS} AND {_OK}) = 0""", "diff_files"))
def t07_alerts(spark, sf):
    path = scratch_path(spark, f"steps-{uuid.uuid4().hex}")
    files = fixture(spark, sf, "diff_files").withColumn("run", F.concat_ws("/", "repo", F.col("pr_number").cast("string")))
    queued = files.groupBy("run", "repo", "pr_number").agg(F.count(F.lit(1)).cast("int").alias("files")).withColumn("kind", F.lit("queued"))
    ended = files.filter(_REPORTS).select("run", "repo", "pr_number", F.lit("file").alias("kind"), F.expr(_OK).alias("ok"))
    later = spark.range(1).select(F.lit("-").alias("run"), F.lit("tick").alias("kind"))
    for i, (rows, minutes) in enumerate([(queued, 0), (ended, 5), (later, 600), (later, 660)]):
        stamped = rows.withColumn("ts", F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {minutes} MINUTES"))
        stamped.coalesce(1).write.mode("append").option("timestampFormat", landing.STAMP).json(f"{path}/{i}")
    return spark.read.parquet(J.run_alerts(spark, f"{path}/*"))
