"""Feedback application, upserts, content ids and versioned tables."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from revlens.operators import feedback as FB
from revlens.sources import sinks


def test_latest_feedback_wins_and_unknown_ids(spark):
    reviews = spark.createDataFrame([(1, -1, "x"), (2, 0, "y")], "review_id long, accepted int, comment string")
    t0 = dt.datetime(2024, 1, 1)
    fb = spark.createDataFrame([(10, 1, 1, t0), (11, 1, 0, t0 + dt.timedelta(hours=1)), (12, 99, 1, t0)],
                               "feedback_id long, review_id long, accepted int, ts timestamp")
    got = {r.review_id: (r.accepted, r.comment) for r in FB.apply_feedback(reviews, fb).collect()}
    assert got == {1: (0, "x"), 2: (0, "y")}
    assert [r.review_id for r in FB.unknown_feedback(fb, reviews).collect()] == [99]


def test_upsert_replaces_and_inserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, "c", 1)], "id long, v string, seq int")
    got = {r.id: r.v for r in FB.upsert(old, new, "id", seq="seq").collect()}
    assert got == {1: "a", 2: "BB", 3: "c"}


def test_upsert_keeps_columns_the_update_lacks(spark):
    old = spark.createDataFrame([(1, "a", 5, [1.0])], "id long, v string, accepted int, embedding array<double>")
    new = spark.createDataFrame([(1, None), (2, "c")], "id long, v string")
    got = {r.id: (r.v, r.accepted, r.embedding) for r in FB.upsert(old, new, "id").collect()}
    assert got == {1: (None, 5, [1.0]), 2: ("c", None, None)}


def test_content_id_matches_python(spark):
    rule, lang, cat = "  Never store secrets.  ", "", "security"
    digest = hashlib.sha256(f"{cat}:{lang}:{rule.strip()}".encode()).hexdigest()
    want = f"{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:32]}"
    df = spark.createDataFrame([(rule, lang, cat)], "rule string, language string, category string")
    assert df.select(FB.convention_id().alias("i")).first().i == want


def test_prepare_conventions_defaults_and_skip(spark):
    df = spark.createDataFrame([("  ", None, None, None, None), ("Use x", None, None, None, None)],
                               "rule string, language string, category string, added_by string, repo string")
    rows = FB.prepare_conventions(df, repo_override="o/r").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.language, r.category, r.added_by, r.repo) == ("", "general", "system", "o/r")


def test_fill_timestamp_and_random_id(spark):
    df = spark.createDataFrame([("",), ("2024-01-01T00:00:00+00:00",)], "timestamp string")
    got = [r.t for r in df.select(FB.fill_timestamp().alias("t"), FB.random_id().alias("u")).collect()]
    assert got[0].endswith("+00:00") and got[1] == "2024-01-01T00:00:00+00:00"


def test_merge_metadata_right_wins(spark):
    r = spark.range(1).select(FB.merge_metadata(F.create_map(F.lit("accepted"), F.lit("-1"), F.lit("repo"), F.lit("a")),
                                                F.create_map(F.lit("accepted"), F.lit("1"))).alias("m")).first().m
    assert r == {"accepted": "1", "repo": "a"}


def test_versioned_table_roundtrip(spark, tmp_path):
    base = str(tmp_path / "reviews")
    sinks.write_version(spark.createDataFrame([(1, "a")], "id long, v string"), base)
    df = sinks.read_table(spark, base)
    # upsert reading the current version and writing the next one
    sinks.write_version(FB.upsert(df, spark.createDataFrame([(1, "b")], "id long, v string"), "id"), base)
    assert sinks.table_versions(spark, base) == [0, 1]
    assert sinks.read_table(spark, base).first().v == "b"


def test_review_store_layout_prunes_dates(spark, tmp_path):
    from data_paths import SF001
    from revlens.sources.fixtures import fixture
    base = str(tmp_path / "store")
    path = sinks.write_review_store(fixture(spark, SF001, "reviews").filter("ts IS NOT NULL"), base, vec_col=None)
    df = spark.read.parquet(path)
    one_day = df.filter(F.col("date") == "2024-01-02").filter(F.col("repo") == "src1")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-02" in plan
    assert "EqualTo(repo,src1)" in plan
    assert one_day.count() == fixture(spark, SF001, "reviews").filter(
        (F.to_date("ts") == "2024-01-02") & (F.col("repo") == "src1")).count()
