"""Session helpers: spreading narrow inputs, checkpoint folder, outboxes."""

import os
import time

from pyspark.sql import functions as F

from revlens.session import checkpoint_dir, spread, written
from revlens.sources import sinks

from data_paths import SF001


def test_spread_only_narrow_shuffle_free_inputs(spark):
    one = spark.read.parquet(f"{SF001}/events.parquet")
    assert one.rdd.getNumPartitions() == 1
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shuffled = one.groupBy("event_type").count()
    assert spread(shuffled) is shuffled          # already distributed by its exchange
    wide = spark.range(0, 1000, 1, 16)
    assert spread(wide) is wide


def test_checkpoint_dir_is_kept_when_set(spark):
    d = checkpoint_dir(spark)
    assert d and checkpoint_dir(spark) == d


def test_outbox_keeps_all_batches_and_reruns_add_nothing(spark, tmp_path):
    ddl, keys = "repo string, pr_number long, filename string, payload string", ["repo", "pr_number", "filename"]
    one = spark.createDataFrame([("r", 1, "a.py", "x"), ("r", 1, "a.py", "x")], ddl)
    two = spark.createDataFrame([("r", 1, "a.py", "y"), ("r", 2, "b.py", "z")], ddl)
    base = str(tmp_path / "outbox")
    for batch, rows in ((0, one), (1, two), (1, two), (0, one)):
        sinks.write_outbox(rows, base, keys, batch)
    assert sorted((r.pr_number, r.payload) for r in sinks.read_outbox(spark, base).collect()) == [(1, "x"), (2, "z")]


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(20_000).withColumn("k", F.col("id") % 50)
    out = written(df.join(df.groupBy("k").count().hint("merge"), "k").repartition(5), "t")
    until = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < until:   # deleted in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 20_000 and out.agg(F.sum("count")).first()[0] == 20_000 * 400
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None   # as the session had it
