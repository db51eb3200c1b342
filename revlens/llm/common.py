"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from revlens.session import write_parquet


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a folder of our
    own is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="revlens-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the Arrow batches that tasks exchange with Python by bytes: whole
    texts are long, and the default of 64 MB a batch is held several times by
    each worker.  A smaller bound of the session stays."""
    key, limit = "spark.sql.execution.arrow.maxBytesPerBatch", int(size[:-1]) << 20
    have = spark.conf.get(key, None) or "-1"
    number = int(have.rstrip("b")) if have.rstrip("b").lstrip("-").isdigit() else -1
    if not 0 < number <= limit:
        spark.conf.set(key, str(limit))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written in the shared folder.

    Used where a small derived table is read more than once, and where a join
    must see a plain exchange on both sides so that adaptive execution can
    split a skewed partition.  A written table also has sizes of its own: those
    of a checkpoint are estimates carried through all joins before it, whose
    products grow without bound in a loop.  The shuffle files of the job that
    writes it go with its end.
    """
    path = scratch(df.sparkSession, "cut")
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for one run's files."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def reuse_memory() -> None:
    """Let the process use the memory of freed arrays again.  The C library gives large blocks back at once, so that work
    on arrays of some hundred KB spends much of its time on new pages; freeing one block of just under its bound of 32 MB
    (never touched, so without pages) makes it keep up to twice that."""
    np.empty(31 << 20, np.uint8)


def string_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, offsets


def slices(arr, limit: int = 1 << 20):
    """Row ranges of a string array with at most ``limit`` bytes each (one
    longer text makes a range of its own), as (first row, last row + 1, bytes,
    offsets from 0): bounds the memory of vectorised work on whole texts."""
    body, off = string_buffers(arr)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, body[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b
