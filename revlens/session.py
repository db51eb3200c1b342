"""SparkSession construction and shared settings.

The library never creates its own cluster settings on a session it is handed;
``get_session`` is only for tests, the bench and command-line use.  Jobs that
need a durable folder (checkpoints, versioned tables) read
``spark.checkpoint.dir`` from the session and only fall back to a scratch
folder when it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job relies on for results to match the reference:
#  - UTC session zone (timestamps are stored as UTC ISO text)
#  - LAST_WIN map-key dedup (dict merge where the right side wins)
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Execution settings: adaptive execution re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target ~256 MB per post-shuffle partition and per scan split: set
    # spark.sql.shuffle.partitions high on a cluster and let AQE coalesce
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(REQUIRED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("REVLENS_DRIVER_MEMORY", "16g"))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Set the settings results depend on, on any session, and make the
    library importable by the Python workers."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ship_library(spark)


_SHIPPED: set = set()


def ship_library(spark: SparkSession) -> None:
    """Distribute this package to the executors' Python workers (once per
    SparkContext) with ``addPyFile``, as a cluster deployment would."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="revlens-pyfiles-")
    zpath = os.path.join(out_dir, "revlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared durable folder for checkpoints and versioned tables.

    Read from ``spark.checkpoint.dir``; when the cluster names none (tests,
    local runs) a fresh scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="revlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint dir for one job's durable outputs."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df, path: str) -> None:
    """Write ``df`` and delete the shuffle files of that job at its end.

    Spark keeps them until the driver collects its garbage, which a long job of
    many tables does too seldom for the disk; no later job reads them, each
    plans its own shuffles.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before) if before is not None else conf.unset(CLEAN_UP)


def written(df, name: str):
    """``df`` as a table written once under the shared checkpoint folder: cuts
    lineage, fixes its rows for every later read and has sizes of its own."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df, *names: str):
    """``df`` with its computed columns ``names`` as fixed values: a later filter or
    column reads them, where Spark would else move the filter below and compute
    their expressions anew for every mention (a generator stops that)."""
    held = F.explode(F.array(F.struct(*names)))
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, held.alias("_settled")).select(*[F.col(f"_settled.{c}") if c in names else F.col(c) for c in df.columns])


def spread(df, min_partitions: int | None = None, enough: int | None = None):
    """Spread a narrow input across the cluster before CPU-heavy row-local
    work (JSON parse, HMAC, diff parsing).

    Only a plan without any shuffle is considered: a scan of large,
    splittable files already has many partitions and is left alone; a small
    single-row-group file is one partition and would run on one core, so it
    is round-robin repartitioned.  A plan that already shuffles is spread by
    its exchange and returned unchanged (checking it would execute it).
    Rows much larger than the work on them are only moved from fewer than
    ``enough`` partitions.
    """
    if df.isStreaming:
        return df      # a stream is spread by its source's file splits
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan:
        return df
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(target, enough or target):
        return df.repartition(target)
    return df
