"""Landed webhook deliveries (S01, T01): JSON lines in a folder, read with a fixed schema.

One line is one delivery: its id, arrival time, event header, signature header
and the raw body as it was signed.  Lines that are no such record are kept as
they are in ``_corrupt`` and become dead letters; every row names the file that
it came from.  The same reader serves batch and stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas as S

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LINES = 50_000      # of a landed file: a compressed one is read by one task
LANDED_SCHEMA = T.StructType([*S.DELIVERY_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])


def _rows(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"landed_file": F.col("_metadata.file_path"), "landed_at": F.col("_metadata.file_modification_time")})


def _options(reader):
    return (reader.schema(LANDED_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .option("recursiveFileLookup", "true").option("timestampFormat", STAMP))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """All landed lines: the delivery's columns, ``_corrupt``, ``landed_file``, ``landed_at``."""
    return _rows(_options(spark.read).json(path))


def stream_landed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream: files are picked up as they land."""
    r = _options(spark.readStream)
    return _rows((r.option("maxFilesPerTrigger", max_files) if max_files else r).json(path))


def is_delivery():
    """True for a whole record: the line was read and names its delivery and body."""
    return F.col("_corrupt").isNull() & F.col("delivery_id").isNotNull() & F.col("body").isNotNull()


def good(landed: DataFrame) -> DataFrame:
    """Deliveries to route."""
    return landed.filter(is_delivery()).drop("_corrupt")


def line_and_reason():
    """Of a row that is no delivery: the line as it landed and what is wrong with it."""
    return (F.coalesce("_corrupt", F.to_json(F.struct(*[f.name for f in S.DELIVERY_SCHEMA.fields]))),
            F.when(F.col("_corrupt").isNotNull(), F.lit("not a delivery record")).otherwise(F.lit("delivery without id or body")))


def bad_lines(landed: DataFrame) -> DataFrame:
    """Dead letters of the landing step: (landed_file, line, reason)."""
    line, reason = line_and_reason()
    return landed.filter(~is_delivery()).select("landed_file", line.alias("line"), reason.alias("reason"))


def land(deliveries: DataFrame, path: str) -> None:
    """Write deliveries as landed files, compressed; a file holds few enough lines to be one task's reading."""
    rows = deliveries.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.DELIVERY_SCHEMA.fields])
    rows.write.mode("append").option("timestampFormat", STAMP).option("compression", "gzip").option("maxRecordsPerFile", LINES).json(path)
