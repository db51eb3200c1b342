"""Table writes (S12-S14) and outbox sinks.

Tables live under the shared folder the session names in
``spark.checkpoint.dir`` (or a path the caller gives).  A table is a set of
immutable version folders ``<table>/_v=<n>``: a write never overwrites the
folder a reader (or the same job) is reading, and the newest complete
version is the table.  Writing a version also cuts the lineage of the
DataFrame it was computed from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.session import scratch_path, written


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_file(spark: SparkSession, path: str) -> bool:
    """True for a path that is one file, False for a folder, a pattern or nothing."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def table_versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("_v=") and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(name[3:]))
    return sorted(out)


def latest_path(spark: SparkSession, base: str) -> str | None:
    v = table_versions(spark, base)
    return f"{base.rstrip('/')}/_v={v[-1]}" if v else None


def read_table(spark: SparkSession, base: str, schema=None) -> DataFrame | None:
    path = latest_path(spark, base)
    if path is None:
        return None
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path)


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the next version of the table at ``base``; returns its path."""
    spark = df.sparkSession
    v = table_versions(spark, base)
    path = f"{base.rstrip('/')}/_v={(v[-1] + 1) if v else 0}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def reset_table(df: DataFrame, base: str) -> str:
    """Replace the table's content (a new version; old ones can be vacuumed)."""
    return write_version(df, base)


def table_base(spark: SparkSession, name: str) -> str:
    """Default location of a named table under the shared checkpoint folder."""
    return scratch_path(spark, f"tables/{name}")


def _done(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def folders(spark: SparkSession, base: str, mark: str) -> list[int]:
    """Numbers n of the complete folders ``<base>/<mark>=<n>``."""
    fs, p = _fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in (int(x[len(mark) + 1:]) for x in names if x.startswith(f"{mark}=")) if _done(spark, f"{base}/{mark}={n}"))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def merge_epoch(batch: DataFrame, epoch: int, base: str, keys: list[str], bucket) -> None:
    """One epoch of a keyed sink: rows of ``batch`` replace those with the same keys.

    The table lies in folders by ``bucket`` (a function of the keys), and only
    the buckets that the batch touches are read and overwritten.  The merged
    rows are staged under the epoch's number first: an epoch that runs again
    writes the same staged rows again, so it changes nothing and a crash while
    folders are replaced loses nothing.
    """
    spark = batch.sparkSession
    data, stage = f"{base}/data", f"{base}/staged/e={epoch}"
    if not _done(spark, stage):
        new = written(batch.withColumn("bucket", bucket.cast("string")), "epoch")
        fs, p = _fs(spark, data)
        if fs.exists(p):
            old = spark.read.schema(new.schema).parquet(data).join(new.select("bucket").distinct(), "bucket", "left_semi")
            new = new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
        new.write.mode("overwrite").parquet(stage)
    staged = spark.read.parquet(stage)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(data)
    for n in folders(spark, f"{base}/staged", "e"):
        if n < epoch:
            remove(spark, f"{base}/staged/e={n}")


def read_keyed(spark: SparkSession, base: str) -> DataFrame | None:
    """The table of a keyed sink."""
    fs, p = _fs(spark, f"{base}/data")
    return spark.read.parquet(f"{base}/data").drop("bucket") if fs.exists(p) else None


def write_outbox(df: DataFrame, base: str, keys: list[str], batch: str | int) -> str:
    """Outbox rows (S16-S19) keyed by ``keys``, appended as batch ``batch``.

    Keys that another batch already holds are left out, and a batch that runs
    again rewrites its own folder, so no payload is emitted twice and none of
    an earlier batch is lost.
    """
    spark = df.sparkSession
    path = f"{base.rstrip('/')}/_batch={batch}"
    rows = df.dropDuplicates(keys)
    others = [p for p in _batches(spark, base) if p.rstrip("/").rsplit("/", 1)[-1] != f"_batch={batch}"]
    if others:
        rows = rows.join(spark.read.parquet(*others).select(*keys), keys, "left_anti").select(df.columns)
    rows.write.mode("overwrite").parquet(path)
    return path


def _batches(spark: SparkSession, base: str) -> list[str]:
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    found = [st.getPath() for st in fs.listStatus(p) if st.getPath().getName().startswith("_batch=")]
    return [x.toString() for x in found if fs.exists(x.suffix("/_SUCCESS"))]


def read_outbox(spark: SparkSession, base: str) -> DataFrame | None:
    """All complete batches of an outbox."""
    paths = _batches(spark, base)
    return spark.read.parquet(*paths) if paths else None


def write_review_store(reviews, base: str, ts_col: str = "ts", vec_col: str | None = "embedding") -> str:
    """The review store layout: partitioned by event date (a day's reviews are
    appended as new partitions; date filters prune whole folders), clustered
    by repository inside each file (repo-scoped reads skip row groups by
    min/max statistics), vector norms stored beside the vectors.

    High-cardinality repositories are deliberately not partition folders.
    """
    from pyspark.sql import functions as F
    df = reviews.withColumn("date", F.to_date(F.col(ts_col)))
    if vec_col and vec_col in reviews.columns:
        df = df.withColumn("norm", F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0),
                                                      lambda acc, x: acc + x.cast("double") * x.cast("double"))))
    # range-partition on (date, repo, id): a hot day or a hot repository is
    # spread over several writer tasks instead of one
    key = [c for c in ("date", "repo", "review_id") if c in df.columns]
    df = df.repartitionByRange(*key).sortWithinPartitions(*key)
    return write_version(df, base, partition_by=["date"])
