"""Review store, vector store, landed deliveries and the closed review flow."""

import os

import pytest
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.plans import review_flow as RF
from revlens.sources import landing
from revlens.sources import review_store as RS
from revlens.sources import vector_store as VS
from revlens.sources.fixtures import TEST_WEBHOOK_SECRET, fixture, landed_deliveries

from data_paths import SF001


def _files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def _reviews(spark, days=6, per_day=20):
    rows = [(f"r{d}-{i}", f"o/r{i % 3}", f"2024-03-{d + 1:02}T10:00:00.000000", "text", d) for d in range(days) for i in range(per_day)]
    return spark.createDataFrame(rows, "review_id string, repo string, timestamp string, comment string, pr_number int")


def test_upsert_rewrites_only_the_days_it_touches(spark, tmp_path):
    base = str(tmp_path / "store")
    RS.append_reviews(_reviews(spark), base)
    before = _files(base)
    ids = [f"r{d}-{i}" for d in (1, 4) for i in range(5)]
    marks = spark.createDataFrame([(x, 1) for x in ids], "review_id string, accepted int")
    days = RS.upsert_reviews(spark, base, marks)
    assert sorted(str(r.date) for r in days.collect()) == ["2024-03-02", "2024-03-05"]
    after = _files(base)
    kept = {f for f in before if "2024-03-02" not in f and "2024-03-05" not in f}
    assert kept <= after and not (before - kept) & after
    rows = {r.review_id: r for r in RS.read_reviews(spark, base).collect()}
    assert len(rows) == 120 and {k for k, r in rows.items() if r.accepted == 1} == set(ids)
    assert all(r.comment == "text" and r.accepted in (1, S.UNRATED) for r in rows.values())


def test_upsert_adds_new_keys_and_never_moves_a_row(spark, tmp_path):
    base = str(tmp_path / "store")
    new = spark.createDataFrame([("n1", "2024-05-01T00:00:00", "a"), ("n2", "", "b"), ("n3", None, None)],
                                "review_id string, timestamp string, comment string")
    RS.upsert_reviews(spark, base, new)                           # into a store that is not there yet
    RS.append_reviews(_reviews(spark, 2, 3), base)
    moved = spark.createDataFrame([("r0-1", "2025-01-01T00:00:00", "late"), ("n4", "2024-03-01T09:00:00", "same day")],
                                  "review_id string, timestamp string, comment string")
    RS.upsert_reviews(spark, base, moved)
    RS.upsert_reviews(spark, base, moved)                         # again: nothing changes
    rows = {r.review_id: r for r in RS.read_reviews(spark, base).collect()}
    assert len(rows) == 3 + 6 + 1
    assert str(rows["r0-1"].date) == "2024-03-01" and rows["r0-1"].comment == "late"
    assert str(rows["n4"].date) == "2024-03-01" and rows["n4"].accepted == S.UNRATED
    assert rows["n2"].timestamp and rows["n2"].date is not None and rows["n3"].date is not None     # X14
    assert [f.name for f in RS.read_reviews(spark, base).schema] == [f.name for f in S.REVIEW_SCHEMA] + ["date"]


def test_upsert_takes_the_greatest_of_repeated_updates(spark, tmp_path):
    base = str(tmp_path / "store")
    RS.append_reviews(_reviews(spark, 1, 4), base)
    marks = spark.createDataFrame([("r0-0", 1, 5), ("r0-0", 0, 9), ("r0-0", 1, 7), ("new", 1, 1), ("new", 0, 2)], "review_id string, accepted int, seq int")
    RS.upsert_reviews(spark, base, marks, seq="seq")
    rows = {r.review_id: r.accepted for r in RS.read_reviews(spark, base).collect()}
    assert rows["r0-0"] == 0 and rows["new"] == 0 and len(rows) == 5


def test_a_text_is_embedded_once_over_all_runs(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        def embed(texts):
            import hashlib
            for t in texts:
                if t == "bad":
                    raise RuntimeError("no vector")
                with open(calls / hashlib.md5(t.encode()).hexdigest(), "a") as f:
                    f.write("x")
            return [[float(len(t)), 1.0] for t in texts]
        return embed

    base = str(tmp_path / "vectors")
    one = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", "a", None, ""])], "id int, text string")
    got = {r.id: r.embedding for r in VS.embedded(one, "text", base, factory, "m").collect()}
    assert got[0] == got[2] == [1.0, 1.0] and got[1] == [2.0, 1.0] and got[4] == got[5] == [0.0, 1.0]
    two = spark.createDataFrame([(1, "bb"), (2, "ccc")], "id int, text string")
    assert VS.embedded(two, "text", base, factory, "m").count() == 2
    assert sorted(len((calls / f).read_text()) for f in os.listdir(calls)) == [1, 1, 1, 1]
    # a text without a vector is not stored, and is tried again
    three = spark.createDataFrame([(1, "bad")], "id int, text string")
    VS.embed_new(three, "text", base, factory, "m", retry_sleep=lambda s: None)
    assert VS.with_vectors(three, "text", base, "m").first().embedding is None
    assert VS.read_vectors(spark, base, "m").count() == 4 and VS.read_vectors(spark, base, "other").count() == 0


def test_landed_lines_that_are_no_delivery_become_dead_letters(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"delivery_id":"1","received_ts":"2024-01-01T00:00:00.123456Z","event_name":"ping","signature":"s","body":"{\\"a\\": 1}"}\n'
                                 '{"delivery_id":"2","bo\n{"event_name":"ping","body":"x"}\n')
    (path / "b.json").write_text("not json at all\n")
    rows = landing.read_landed(spark, str(path))
    good = landing.good(rows).collect()
    assert [(r.delivery_id, r.body, r.received_ts.microsecond) for r in good] == [("1", '{"a": 1}', 123456)]
    assert good[0].landed_file.endswith("a.json") and good[0].landed_at is not None
    bad = {(r.landed_file[-6:], r.reason) for r in landing.bad_lines(rows).collect()}
    assert bad == {("a.json", "not a delivery record"), ("a.json", "delivery without id or body"), ("b.json", "not a delivery record")}


def test_deliveries_are_signed_and_landed_once(spark):
    path = landed_deliveries(spark, SF001)
    files = sorted(os.listdir(f"{path}/deliveries"))
    assert fixture(spark, SF001, "deliveries").count() == 1000
    assert landed_deliveries(spark, SF001) == path and sorted(os.listdir(f"{path}/deliveries")) == files
    plan = fixture(spark, SF001, "deliveries")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    """Two runs of the flow over the same deliveries; the second sees the first one's store."""
    base = str(tmp_path_factory.mktemp("flow"))
    e = RF.md5_embedder(spark, f"{base}/vectors")
    rules = fixture(spark, SF001, "conventions").drop("embedding")
    args = (fixture(spark, SF001, "deliveries"), fixture(spark, SF001, "diff_files"))
    first = RF.review_prs(*args, RS.read_reviews(spark, f"{base}/store").drop("date"), rules, TEST_WEBHOOK_SECRET, e)
    RF.store_reviews(spark, f"{base}/store", first)
    vectors = VS.read_vectors(spark, e.base, e.name).count()
    second = RF.review_prs(*args, RS.read_reviews(spark, f"{base}/store").drop("date"), rules, TEST_WEBHOOK_SECRET, e)
    RF.store_reviews(spark, f"{base}/store", second)
    return first, second, base, vectors, e


def test_a_second_run_retrieves_the_first_ones_reviews(spark, flow):
    first, second, base, vectors, e = flow
    stored = RS.read_reviews(spark, f"{base}/store")
    files = first["file_reviews"].count()
    assert files > 0 and stored.count() == files                   # the second run wrote the same keys
    assert stored.filter("accepted = -1 AND line = 0 AND embedding IS NOT NULL AND timestamp <> ''").count() == files
    assert "Findings on similar code" not in "".join(r.user_prompt for r in first["prompts"].collect())
    assert all("Findings on similar code" in r.user_prompt for r in second["prompts"].collect())
    assert VS.read_vectors(spark, e.base, e.name).count() == vectors   # no known text is embedded again


def test_outboxes_of_the_flow(spark, flow):
    first = flow[0]
    prs = {(r.repo, r.pr_number) for r in first["file_reviews"].select("repo", "pr_number").distinct().collect()}
    for name in ("summary_outbox", "notification_outbox", "completion_outbox"):
        assert {(r.repo, r.pr_number) for r in first[name].collect()} == prs
    assert first["alert_outbox"].count() == 0
    counts = first["file_counts"].collect()
    assert all(r.files_fetched >= r.files_reviewable >= r.files_reviewed for r in counts) and sum(r.files_reviewed for r in counts) > 0


def test_alerts_for_prs_whose_files_all_failed(spark, flow):
    def failing():
        def review(prompt):
            if int(prompt["pr_number"]) % 2 == 0:
                raise TimeoutError("model timed out")
            return {"summary": "fine text", "comments": [], "has_issues": False}
        return review

    base = flow[2]
    out = RF.review_prs(fixture(spark, SF001, "deliveries"), fixture(spark, SF001, "diff_files"),
                        RS.read_reviews(spark, f"{base}/none").drop("date"), fixture(spark, SF001, "conventions").drop("embedding"),
                        TEST_WEBHOOK_SECRET, flow[4], model_factory=failing, retry_sleep=lambda s: None)
    alerts = out["alert_outbox"].collect()
    reviewed = {r.pr_number for r in out["reviewed"].select("pr_number").distinct().collect()}
    assert {r.pr_number for r in alerts} == {p for p in reviewed if p % 2 == 0}
    assert all(r.kind == "alert" and r.repo in r.text for r in alerts)
    assert out["nothing_reviewable"].select(F.count(F.lit(1))).first()[0] >= 0


def test_landed_files_are_compressed_and_of_bounded_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "LINES", 40)
    rows = spark.range(100).coalesce(1).select(
        F.col("id").cast("string").alias("delivery_id"), F.lit("ping").alias("event_name"),
        F.timestamp_seconds("id").alias("received_ts"), F.lit("s").alias("signature"), F.concat(F.lit("a\u00e9\n"), F.col("id")).alias("body"))
    landing.land(rows, str(tmp_path / "in"))
    files = [f for f in os.listdir(tmp_path / "in") if f.startswith("part-")]
    assert len(files) == 3 and all(f.endswith(".gz") for f in files)
    got = landing.good(landing.read_landed(spark, str(tmp_path / "in"))).select("delivery_id", "received_ts", "body")
    assert sorted(got.collect()) == sorted(rows.select("delivery_id", "received_ts", "body").collect())
