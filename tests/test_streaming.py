"""Streaming jobs: several micro-batches give the batch answer."""

import os
import shutil

from pyspark.sql import functions as F

from revlens.operators import feedback as FB
from revlens.sources import sinks
from revlens.sources.fixtures import fixture
from revlens.streaming import jobs as J

from data_paths import SF001


def test_incremental_feedback_over_several_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    landing = tmp_path / "landing"
    # three landing files, read one per micro-batch
    for i, part in enumerate(events.randomSplit([1.0, 1.0, 1.0], seed=3)):
        part.coalesce(1).write.parquet(str(landing / f"part{i}"))
    files = []
    for d in sorted(os.listdir(landing)):
        for f in os.listdir(landing / d):
            if f.endswith(".parquet"):
                dst = landing / f"{d}.parquet"
                shutil.copy(landing / d / f, dst)
                files.append(dst)
        shutil.rmtree(landing / d)
    reviews = fixture(spark, SF001, "reviews")
    fb_stream = J.feedback_stream(spark, str(landing), max_files=1)
    base = J.incremental_feedback(spark, reviews, fb_stream, base=str(tmp_path / "out"))
    got = {r.review_id: r.accepted for r in J.current_reviews(spark, base).collect()}
    want = {r.review_id: r.accepted for r in FB.apply_feedback(reviews, fixture(spark, SF001, "feedback")).collect()}
    assert got == want
    assert len(J.open_epochs(spark, base)) >= 3        # one log folder per micro-batch
    J.compact(spark, base)
    assert {r.review_id: r.accepted for r in J.current_reviews(spark, base).collect()} == want


def _feedback(spark, tmp_path):
    """A feedback job fed by hand: (folder of the job, function that lands marks and runs the stream)."""
    landing_dir, base = tmp_path / "marks", str(tmp_path / "job")
    reviews = spark.createDataFrame([(i, -1) for i in range(6)], "review_id long, accepted int")
    n = iter(range(100))

    def add(*marks):
        rows = spark.createDataFrame(list(marks), "review_id long, accepted int, ts long, feedback_id long").withColumn("ts", F.timestamp_seconds("ts"))
        rows.coalesce(1).write.json(str(landing_dir / f"f{next(n)}"))
        stream = spark.readStream.schema("review_id long, accepted int, ts timestamp, feedback_id long").json(f"{landing_dir}/*")
        J.incremental_feedback(spark, reviews, stream, base=base)

    def now():
        return {r.review_id: r.accepted for r in J.current_reviews(spark, base).collect()}

    return base, add, now


def test_folding_the_feedback_log_loses_and_doubles_nothing(spark, tmp_path):
    base, add, now = _feedback(spark, tmp_path)
    add((1, 1, 100, 1), (2, 0, 100, 2), (77, 1, 100, 3))
    add((1, 0, 200, 4))
    want = {0: -1, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1}
    assert now() == want
    n, folded = J.fold(spark, base)                     # a crash before the marker: the old snapshot and its epochs stay in force
    assert now() == want and len(J.open_epochs(spark, base)) == 2
    J.commit(spark, base, n, folded)                    # a crash before the epochs are retired: they are read no more
    assert now() == want and J.open_epochs(spark, base) == []
    J.retire(spark, base)
    assert sinks.folders(spark, f"{base}/log", "e") == [] and now() == want
    opened = J.current_reviews(spark, base).inputFiles()
    assert opened and not any("/log/" in f or "s=0" in f for f in opened)
    add((1, 1, 150, 5), (3, 1, 50, 6))                  # a mark older than a folded one comes late
    assert now() == {**want, 3: 1}
    add((2, 1, 100, 9))                                 # same time, later id
    assert J.compact(spark, base) == n + 1 and now() == {**want, 3: 1, 2: 1}
    assert J.compact(spark, base) == n + 1              # nothing to fold
    waiting = spark.read.parquet(f"{base}/pending/s={n + 1}").collect()
    assert [(r.review_id, r.accepted) for r in waiting] == [(77, 1)]   # a mark whose review is not there is kept


def _days(spark, tmp_path):
    folder, base = tmp_path / "days", str(tmp_path / "gold")
    n = iter(range(100))

    def add(*stamps):
        rows = spark.createDataFrame([(s,) for s in stamps], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.json(str(folder / f"f{next(n)}"))
        stream = spark.readStream.schema("ts timestamp").json(f"{folder}/*")
        J.run_gold(spark, J.issues_per_day_stream(stream), "days", ["date"], J.day_bucket(), base=base)
        return {r.date: r.issues for r in sinks.read_keyed(spark, base).collect()}

    return base, add


def test_late_rows_and_state_of_issues_per_day(spark, tmp_path):
    import json

    base, add = _days(spark, tmp_path)
    assert add("2024-01-01 10:00:00", "2024-01-02 10:00:00") == {"2024-01-01": 1, "2024-01-02": 1}
    assert add("2024-01-01 23:00:00")["2024-01-01"] == 2                       # late, inside the delay
    first = add("2024-01-09 10:00:00")
    assert add("2024-01-01 12:00:00", "2024-01-09 11:00:00") == {**first, "2024-01-09": 2}   # beyond it: dropped
    assert first["2024-01-01"] == 2
    # the last epoch's files of state hold the open days only
    q = J.issues_per_day_stream(spark.readStream.schema("ts timestamp").json(f"{tmp_path}/days/*"))
    w = q.writeStream.outputMode("update").foreachBatch(lambda b, e: None).option("checkpointLocation", f"{base}/_checkpoint")
    add("2024-01-09 12:00:00")
    run = J.run_available_now(w)
    state = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if json.loads(p.json)["stateOperators"]]
    assert all(n <= 1 for n in state)


def test_an_epoch_that_runs_again_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "keyed")

    def rows(*values):
        return spark.createDataFrame(list(values), "repo string, n long")

    sinks.merge_epoch(rows(("a", 1), ("b", 1), ("c", 1)), 0, base, ["repo"], J.repo_bucket())
    sinks.merge_epoch(rows(("a", 2), ("d", 1)), 1, base, ["repo"], J.repo_bucket())
    want = {"a": 2, "b": 1, "c": 1, "d": 1}
    assert {r.repo: r.n for r in sinks.read_keyed(spark, base).collect()} == want
    data = f"{base}/data"
    shutil.rmtree(os.path.join(data, sorted(os.listdir(data))[-1]))            # a crash while folders were replaced
    sinks.merge_epoch(rows(("a", 2), ("d", 1)), 1, base, ["repo"], J.repo_bucket())
    got = {r.repo: r.n for r in sinks.read_keyed(spark, base).collect()}
    assert got["a"] == 2 and got["d"] == 1 and len(got) >= 3
    sinks.merge_epoch(rows(("a", 2), ("d", 1)), 1, base, ["repo"], J.repo_bucket())
    assert {r.repo: r.n for r in sinks.read_keyed(spark, base).collect()} == got
    assert sinks.folders(spark, f"{base}/staged", "e") == [1]


def test_alerts_of_review_runs(spark, tmp_path):
    folder = tmp_path / "steps"

    def land(i, *rows):
        full = [(run, "o/r", pr, kind, files, ok, f"2024-01-01 {h:02}:00:00") for run, pr, kind, files, ok, h in rows]
        df = spark.createDataFrame(full, "run string, repo string, pr_number long, kind string, files int, ok boolean, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.json(str(folder / str(i)))

    land(0, ("fine", 1, "queued", 2, None, 1), ("bad", 2, "queued", 2, None, 1), ("stuck", 3, "queued", 2, None, 1), ("none", 4, "queued", 0, None, 1),
         ("early", 5, "file", None, False, 1))
    land(1, ("fine", 1, "file", None, False, 1), ("bad", 2, "file", None, False, 1), ("stuck", 3, "file", None, True, 1))
    land(2, ("fine", 1, "file", None, True, 1), ("bad", 2, "file", None, False, 1), ("early", 5, "queued", 1, None, 1))
    land(3, ("-", 0, "tick", None, None, 9))
    land(4, ("-", 0, "tick", None, None, 10))
    land(5, ("stuck", 3, "file", None, True, 10))
    land(6, ("-", 0, "tick", None, None, 20))
    land(7, ("-", 0, "tick", None, None, 21))
    got = sorted((r.run, r.reason, r.files, r.failed) for r in spark.read.parquet(J.run_alerts(spark, f"{folder}/*", base=str(tmp_path / "a"))).collect())
    assert got == [("bad", "all files failed", 2, 2), ("early", "all files failed", 1, 1), ("stuck", "not finished", 2, 0)]


def test_tables_in_folders_of_several_files(spark, tmp_path, monkeypatch):
    """A table may be one file or a folder of files that has the table's name."""
    from revlens.plans import q_streaming

    days = [(i, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(9)]
    docs = spark.createDataFrame([(i, f"text {i}", f"src{i % 2}") for i, _ in days], "doc_id long, text string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i, _ in days], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    events = spark.createDataFrame(days, "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    sf = str(tmp_path)
    monkeypatch.setattr(J, "GOLD_REFRESH", "1 second")
    assert {r.date: r.issues for r in q_streaming.t04(spark, sf).collect()} == {f"2024-01-0{d}": 3 for d in (1, 2, 3)}
    for q in (q_streaming.t05, q_streaming.t08):
        assert {r.repo: (r.total_reviews, r.accepted) for r in q(spark, sf).collect()} == {"src0": (5, 0), "src1": (4, 4)}


def test_gold_refresh_trigger(spark):
    q, base = J.run_gold(spark, J.issues_per_day_stream(J.reviews_stream(spark, SF001)), "daily_test", ["date"], J.day_bucket(),
                         trigger=J.GOLD_REFRESH)
    try:
        q.processAllAvailable()
        assert sinks.read_keyed(spark, base).count() > 0
    finally:
        q.stop()


def test_a_stream_that_is_not_done_in_time_raises(spark, tmp_path):
    import time

    import pytest

    from revlens.streaming.jobs import run_available_now
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

    def slow(batch, epoch):
        time.sleep(6)

    writer = stream.writeStream.foreachBatch(slow).option("checkpointLocation", str(tmp_path / "c"))
    with pytest.raises(TimeoutError):
        run_available_now(writer, timeout_s=1)
    assert not spark.streams.active


def test_dead_letters_take_one_pass(spark, tmp_path, monkeypatch):
    import json

    def line(i, body, good=True):
        return json.dumps({"delivery_id": str(i), "received_ts": "2024-01-01T00:00:00.000000Z", "event_name": "ping", "body": body,
                           "signature": hmac_of("s" if good else "other", body)})

    def hmac_of(secret, body):
        import hashlib
        import hmac
        return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()

    (tmp_path / "land").mkdir()
    lines = [line(1, "{}"), line(2, "{}", False), '{"delivery_id":"3","body":"{', '{"delivery_id":"4"}', line(5, '{"a":1}')]
    (tmp_path / "land" / "a.json").write_text("\n".join(lines) + "\n")
    routed, route = spark.sparkContext.accumulator(0), J.E.route

    def counted(deliveries, secret):
        def run(batches):
            for b in batches:
                routed.add(b.num_rows)
                yield b
        out = route(deliveries, secret)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(J.E, "route", counted)
    ok, dead = J.route_with_dead_letters(spark, str(tmp_path / "land"), "s")
    assert routed.value == len(lines)                                          # not once for each table
    got = {(r.delivery_id, r.http_code, r.reason, r.body) for r in spark.read.parquet(dead).collect()}
    assert {x for x in got if x[0] is not None} == {(2, 401, "signature mismatch", "{}")}
    assert (None, 400, "not a delivery record", lines[2]) in got
    assert [(json.loads(b)["delivery_id"], c) for i, c, why, b in got if why == "delivery without id or body"] == [("4", 400)]
    assert len(got) == 3
    rows = spark.read.parquet(ok)
    assert {(r.delivery_id, r.status) for r in rows.collect()} == {(1, "ok"), (5, "ok")} and "body" not in rows.columns
