"""Structured Streaming jobs.

Deliveries and feedback land as files; each job is ``readStream`` ->
DataFrame transformations -> ``writeStream`` with a checkpoint in the shared
folder (``spark.checkpoint.dir``).  Sinks are idempotent: append sinks are
file sinks (exactly-once through the checkpoint's commit log), gold tables are
keyed sinks that merge an epoch's changed rows into the folders they touch
(``sinks.merge_epoch``), and the feedback log has one folder per epoch.
"""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revlens.operators import events as E
from revlens.operators import metrics as M
from revlens.session import scratch_path
from revlens.sources import landing, sinks
from revlens.sources.fixtures import TEMPLATES
from revlens.sources.tables import table_path

# Gold tables refresh on this trigger (the dashboard's cache lifetime).
GOLD_REFRESH = "5 minutes"


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's checkpoint and sink."""
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """T01 source: Parquet files landing in a folder (``path`` is the folder, whatever
    its name, or one file, whose name becomes a filter in its folder).

    The schema is taken from the files' footers once, then fixed; event-time
    columns stored without a zone are read as UTC timestamps.
    """
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if sinks.is_file(spark, path):
        folder, name = path.rstrip("/").rsplit("/", 1)
        df = r.option("pathGlobFilter", name).parquet(folder)
    else:
        df = r.parquet(path)
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def run_available_now(writer, timeout_s: float | None = None):
    """Start a stream with the availableNow trigger and wait until it is done.

    With ``timeout_s`` a stream that is not done by then is stopped and
    TimeoutError raised: a half-written sink is never taken for the answer.
    """
    q = writer.trigger(availableNow=True).start()
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream not done after {timeout_s} s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


# ----------------------------------------------------------------- T01/T02

def deliveries(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """T01 source: whole deliveries of the landed files, with a long id as the given tables have."""
    return landing.good(landing.stream_landed(spark, path, max_files)).withColumn("delivery_id", F.col("delivery_id").cast("long"))


def ingest_and_route(spark: SparkSession, path: str, secret: str | None,
                     out: str | None = None) -> str:
    """T01 + T02: continuous ingest; every landed delivery is verified, parsed and
    routed in the stream (stateless) and appended to the routed table."""
    base = out or run_dir(spark, "routed")
    routed = E.route(deliveries(spark, path), secret).select(
        "delivery_id", "received_ts", "event_name", "status", "http_code", "reason", "landed_file",
        F.col("event.repository.full_name").alias("repo"), F.col("event.pull_request.number").alias("pr_number"))
    run_available_now(routed.writeStream.format("parquet").option("path", f"{base}/data")
                      .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append"))
    return f"{base}/data"


# ----------------------------------------------------------------- T03

def dedupe_redeliveries(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop re-deliveries of the same delivery id within the watermark."""
    return stream.withWatermark("received_ts", delay).dropDuplicatesWithinWatermark(["delivery_id"])


def run_dedupe(spark: SparkSession, path: str) -> str:
    base = run_dir(spark, "dedupe")
    d = dedupe_redeliveries(deliveries(spark, path)).select("delivery_id", "received_ts", "event_name")
    run_available_now(d.writeStream.format("parquet").option("path", f"{base}/data")
                      .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append"))
    return f"{base}/data"


# ----------------------------------------------------------------- T04/T05/T08

def reviews_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews arriving as documents; labels and event times are static
    dimension tables joined to the stream (stream-static joins)."""
    docs = landing_stream(spark, table_path(sf_dir, "documents"))
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    events = spark.read.parquet(table_path(sf_dir, "events"))
    return spark.sql(TEMPLATES["reviews"], documents=docs, labels=labels, events=events)


def issues_per_day_stream(reviews: DataFrame, delay: str = "1 day") -> DataFrame:
    """Issues per day kept current.

    A late row inside the watermark's delay changes its day, one beyond it is
    dropped, and a day that the watermark has passed leaves the state.
    """
    return (reviews.filter(F.col("ts").isNotNull())
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day"))
            .agg(F.count(F.lit(1)).alias("issues"))
            .select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("date"), "issues"))


def running_repo_breakdown(reviews: DataFrame) -> DataFrame:
    """Running per-repo counts and acceptance rate (A05 on a stream)."""
    from revlens.functions.lookups import normalise_severity
    from revlens.functions.text import percent_text
    sev = normalise_severity("severity")
    acc = F.col("accepted")
    return (reviews.groupBy("repo")
            .agg(F.count(F.lit(1)).alias("total_reviews"),
                 F.count_if(sev == "critical").alias("critical"), F.count_if(sev == "high").alias("high"),
                 F.count_if(sev == "medium").alias("medium"), F.count_if(sev == "low").alias("low"),
                 F.count_if(acc == 1).alias("accepted"), F.count_if(acc == 0).alias("rejected"),
                 M.acceptance_rate_expr().alias("acceptance_rate"))
            .withColumn("acceptance_pct", percent_text("acceptance_rate")))


REPO_BUCKETS = 64


def day_bucket():
    return F.col("date")


def repo_bucket():
    return F.pmod(F.xxhash64("repo"), F.lit(REPO_BUCKETS))


def run_gold(spark: SparkSession, gold: DataFrame, name: str, keys: list[str], bucket, trigger: str | None = None,
             base: str | None = None):
    """Keep a gold table current: (query or None, folder of the keyed sink).

    Update mode: an epoch brings the rows that changed.  With ``trigger`` (e.g.
    GOLD_REFRESH) the query keeps running and refreshes on that schedule;
    without, it processes what is available and stops.  A given ``base``
    goes on from its checkpoint.
    """
    base = base or run_dir(spark, name)

    def write(batch: DataFrame, epoch: int):
        sinks.merge_epoch(batch, epoch, base, keys, bucket)

    w = (gold.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/_checkpoint"))
    if trigger:
        return w.trigger(processingTime=trigger).start(), base
    run_available_now(w)
    return None, base


# ----------------------------------------------------------------- T06

def feedback_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    events = landing_stream(spark, landing, max_files)
    return spark.sql(TEMPLATES["feedback"], events=events)


def incremental_feedback(spark: SparkSession, reviews: DataFrame, feedback: DataFrame,
                         base: str | None = None) -> str:
    """Fold feedback into the review table batch by batch.

    Each micro-batch costs O(batch): its latest mark per review (with ts and
    feedback id) is written to the log as folder ``log/e=<epoch>`` (a replayed
    epoch rewrites its own folder).  The table is the newest committed snapshot
    with the latest mark of the epochs after it (``current_reviews``);
    ``compact`` folds those epochs into a new snapshot.  Returns the job folder.
    """
    base = base or run_dir(spark, "feedback")
    if not sinks.folders(spark, f"{base}/commits", "c"):
        rows = reviews.withColumns({"_mark_ts": F.lit(None).cast("timestamp"), "_mark_id": F.lit(None).cast("long")})
        rows.write.mode("overwrite").parquet(f"{base}/snapshots/s=0")
        spark.createDataFrame([], "review_id long, accepted int, ts timestamp, feedback_id long").write.mode("overwrite").parquet(f"{base}/pending/s=0")
        commit(spark, base, 0, -1)

    def append(batch: DataFrame, epoch_id: int):
        _latest_marks(batch).write.mode("overwrite").parquet(f"{base}/log/e={epoch_id}")

    run_available_now(feedback.writeStream.foreachBatch(append)
                      .option("checkpointLocation", f"{base}/_checkpoint"))
    return base


def _latest_marks(marks: DataFrame) -> DataFrame:
    return (marks.groupBy("review_id")
            .agg(F.max_by(F.struct(F.col("accepted").cast("int").alias("accepted"), F.col("ts").cast("timestamp").alias("ts"),
                                   F.col("feedback_id").cast("long").alias("feedback_id")), F.struct("ts", "feedback_id")).alias("s"))
            .select("review_id", "s.accepted", "s.ts", "s.feedback_id"))


def commit(spark: SparkSession, base: str, n: int, folded: int) -> None:
    """Marker: snapshot ``n`` holds all epochs up to ``folded``.  Written whole or not at all (its _SUCCESS file counts)."""
    spark.createDataFrame([(n, folded)], "snapshot long, folded long").coalesce(1).write.mode("overwrite").json(f"{base}/commits/c={n}")


def last_commit(spark: SparkSession, base: str) -> tuple[int, int]:
    """(snapshot, last epoch in it) of the newest marker."""
    n = sinks.folders(spark, f"{base}/commits", "c")[-1]
    r = spark.read.schema("snapshot long, folded long").json(f"{base}/commits/c={n}").first()
    return r.snapshot, r.folded


def open_epochs(spark: SparkSession, base: str) -> list[int]:
    """Complete epochs of the log that the newest snapshot does not hold."""
    return [e for e in sinks.folders(spark, f"{base}/log", "e") if e > last_commit(spark, base)[1]]


def _marked(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(reviews with their latest marks, marks without a review) of the newest snapshot and the epochs after it."""
    n = last_commit(spark, base)[0]
    reviews, marks = spark.read.parquet(f"{base}/snapshots/s={n}"), spark.read.parquet(f"{base}/pending/s={n}")
    epochs = open_epochs(spark, base)
    if epochs:
        marks = marks.unionByName(spark.read.schema(marks.schema).parquet(*[f"{base}/log/e={e}" for e in epochs]))
    marks = _latest_marks(marks)
    m = marks.select("review_id", F.struct("ts", "feedback_id").alias("_at"), F.col("accepted").alias("_accepted"))
    # an older mark that comes late does not undo a newer one, folded or not
    newer = F.col("_at").isNotNull() & (F.col("_mark_ts").isNull() | (F.col("_at") > F.struct(F.col("_mark_ts").alias("ts"), F.col("_mark_id").alias("feedback_id"))))
    rows = (reviews.join(m, "review_id", "left")
            .withColumns({"accepted": F.when(newer, F.col("_accepted")).otherwise(F.col("accepted")).cast("int"),
                          "_mark_ts": F.when(newer, F.col("_at.ts")).otherwise(F.col("_mark_ts")),
                          "_mark_id": F.when(newer, F.col("_at.feedback_id")).otherwise(F.col("_mark_id"))})
            .select(reviews.columns))
    return rows, marks.join(reviews.select("review_id"), "review_id", "left_anti")


def current_reviews(spark: SparkSession, base: str) -> DataFrame:
    """The review table as of the last processed epoch (merge on read)."""
    return _marked(spark, base)[0].drop("_mark_ts", "_mark_id")


def fold(spark: SparkSession, base: str) -> tuple[int, int]:
    """Step 1 of ``compact``: write the next snapshot; without its marker nothing reads it."""
    n, folded = last_commit(spark, base)
    epochs = open_epochs(spark, base)
    rows, waiting = _marked(spark, base)
    rows.write.mode("overwrite").parquet(f"{base}/snapshots/s={n + 1}")
    waiting.write.mode("overwrite").parquet(f"{base}/pending/s={n + 1}")
    return n + 1, max([folded, *epochs])


def retire(spark: SparkSession, base: str) -> None:
    """Step 3 of ``compact``: remove what the newest snapshot has made needless."""
    n, folded = last_commit(spark, base)
    for e in sinks.folders(spark, f"{base}/log", "e"):
        if e <= folded:
            sinks.remove(spark, f"{base}/log/e={e}")
    for old in range(n):
        for part in ("snapshots/s", "pending/s", "commits/c"):
            sinks.remove(spark, f"{base}/{part}={old}")


def compact(spark: SparkSession, base: str) -> int:
    """Fold the log into a new snapshot: write it, commit it by a marker, retire the epochs it holds.

    A crash before the marker leaves the old snapshot and its epochs in force, one
    after it the new snapshot; running it again finishes either.  Not while
    another reader still reads the old snapshot.
    """
    if open_epochs(spark, base):
        commit(spark, base, *fold(spark, base))
    retire(spark, base)
    return last_commit(spark, base)[0]


def bench_streaming_upsert(spark: SparkSession, sf_dir: str) -> float:
    """Seconds for T06 over the whole feedback stream at ``sf_dir``."""
    from revlens.sources.fixtures import fixture
    t0 = time.perf_counter()
    incremental_feedback(spark, fixture(spark, sf_dir, "reviews"),
                         feedback_stream(spark, table_path(sf_dir, "events")))
    return time.perf_counter() - t0


# ----------------------------------------------------------------- T07

def route_with_dead_letters(spark: SparkSession, path: str, secret: str | None) -> tuple[str, str]:
    """A bad delivery never fails the micro-batch; it is routed to a
    dead-letter table with its file, code and reason, the rest go on.  Lines that
    are no delivery at all are dead letters without an id."""
    base = run_dir(spark, "deadletter")
    landed = landing.stream_landed(spark, path)

    def split(batch: DataFrame, epoch_id: int):
        # one pass over the landed lines: whatever their end, they are read, verified and parsed once, and staged with the
        # texts of the dead letters alone
        line, why = landing.line_and_reason()
        whole = F.col("_whole")
        read = (batch.withColumns({"_whole": landing.is_delivery(), "_why": F.when(~landing.is_delivery(), why),
                                   "_line": F.when(~landing.is_delivery(), line)})
                .withColumn("delivery_id", F.when(whole, F.col("delivery_id").cast("long"))).drop("_corrupt"))
        status = F.when(whole, F.col("status")).otherwise(F.lit("rejected"))
        staged = f"{base}/staged/_e={epoch_id}"
        (E.route(read, secret)
         .select("delivery_id", status.alias("status"), F.when(whole, F.col("http_code")).otherwise(F.lit(400)).alias("http_code"),
                 F.when(whole, F.col("reason")).otherwise(F.col("_why")).alias("reason"),
                 F.when(status == "rejected", F.when(whole, F.col("body")).otherwise(F.col("_line"))).alias("body"), "landed_file")
         .write.mode("overwrite").parquet(staged))
        b = spark.read.parquet(staged)
        b.filter("status = 'rejected'").write.mode("overwrite").parquet(f"{base}/dead/_e={epoch_id}")
        b.filter("status <> 'rejected'").drop("body").write.mode("overwrite").parquet(f"{base}/ok/_e={epoch_id}")
        sinks.remove(spark, staged)

    run_available_now(landed.writeStream.foreachBatch(split).option("checkpointLocation", f"{base}/_checkpoint"))
    return f"{base}/ok", f"{base}/dead"


#: one step of a review run: kind 'queued' (with the number of files) or 'file' (with its outcome)
STEP_SCHEMA = "run string, repo string, pr_number long, kind string, files int, ok boolean, ts timestamp"
_ALERT = "run string, repo string, pr_number long, reason string, files int, failed int"
_RUN_STATE = "repo string, pr_number long, files int, done int, failed int"


def pr_alerts(steps: DataFrame, patience: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """One alert for each review run whose files all failed ('all files failed') or that
    had not reported all of them ``patience`` after it was queued ('not finished'); none for others.

    ``steps`` is a stream of STEP_SCHEMA.  State is a few counts per run with an
    event-time timer; it goes when the run ends or its timer fires.
    """
    limit = pd.Timedelta(patience)

    def step(key, batches, state: GroupState):
        repo, pr, files, done, failed = state.get if state.exists else (None, None, None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            if files is not None:
                yield pd.DataFrame([(key[0], repo, pr, "not finished", files, failed)],
                                   columns=["run", "repo", "pr_number", "reason", "files", "failed"])
            return
        first = None
        for pdf in batches:
            queued = pdf[pdf["kind"] == "queued"]
            if len(queued):
                q = queued.iloc[0]
                repo, pr, files = q["repo"], int(q["pr_number"]), int(q["files"])
            ended = pdf[pdf["kind"] == "file"]
            done, failed = done + len(ended), failed + int((~ended["ok"].astype(bool)).sum())
            seen = (queued if len(queued) else pdf)["ts"].min()
            first = seen if first is None else min(first, seen)
        if files is not None and done >= files:
            if state.exists:
                state.remove()
            if files > 0 and failed >= files:
                yield pd.DataFrame([(key[0], repo, pr, "all files failed", files, failed)],
                                   columns=["run", "repo", "pr_number", "reason", "files", "failed"])
            return
        state.update((repo, pr, files, done, failed))
        due = int((first + limit).timestamp() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return (steps.withWatermark("ts", delay).groupBy("run")
            .applyInPandasWithState(step, _ALERT, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout))


def run_alerts(spark: SparkSession, path: str, base: str | None = None, **options) -> str:
    """T07 over landed step files (JSON lines), one file a micro-batch: folder of the alerts."""
    base = base or run_dir(spark, "alerts")
    steps = spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    run_available_now(pr_alerts(steps, **options).writeStream.format("parquet").option("path", f"{base}/data")
                      .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append"))
    return f"{base}/data"
