"""Operator 10: deterministic sharded WARC writer, and its reader.

Writing: records are range-sorted by page id into shards, each task writes its
shard as files that are rolled by compressed size, one gzip member for each
record, with regenerated headers and digests.  A file is written under a
temporary name and renamed when complete; names and bytes depend on the rows
alone, so a task that runs twice leaves the same files.  Last, the manifest (a
row for each file with its counts and digest) is written by Spark's own
committer: an archive is complete when its manifest is, and readers take only
the files it lists.

Of records with equal payloads of ``least_bytes`` or more, that with the
smallest page id is a ``response``, the others are ``revisit`` records without
the payload that name it.  Only ids and digests are grouped; a payload crosses
the network for its digest join and its range sort, and a revisit's is dropped
before the latter.

Defined cases: a null payload is empty; a null url gives no target header and
control characters in one are percent-encoded; rows with a null page id are
responses, written first; repeated rows of the response's id are responses
too; extra columns are ignored; an empty table gives an empty manifest and no
records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import cut, scratch

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
_RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "payload string")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's default store gives it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def record_bytes(page_id, url, payload: bytes | None, n_bytes: int, digest: str, refers_to, refers_url, date: str) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes it a revisit of ``refers_to``."""
    def record_id(page):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"

    def clean(u):
        return quote(u, safe="!#$%&'()*+,/:;=?@[]~-._") if u is not None else None

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", date), ("WARC-Target-URI", clean(url)), ("X-Page-Id", page_id),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                 ("WARC-Refers-To-Target-URI", clean(refers_url)), ("X-Refers-To-Page-Id", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time
    return c.compress(data) + c.flush()


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches):
        from pyarrow import fs as afs
        fs, base = afs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        rows, out, state = [], None, {}

        def close():
            out.close()
            fs.move(state["tmp"], f"{base}/{state['file']}")
            return (state["file"], state["records"], state["bytes"], state["sha"].hexdigest(), state["first"], state["last"])

        serial = 0
        for batch in batches:
            for page, url, payload, n, digest, to, to_url in zip(*(c.to_pylist() for c in batch.columns)):
                member = _gzip(record_bytes(page, url, None if payload is None else payload.encode(), n, digest, to,
                                            to_url, date))
                if out is not None and state["bytes"] + len(member) > roll_bytes:
                    rows.append(close())
                    out = None
                if out is None:
                    name = f"shard-{part:06d}-{serial:05d}.warc.gz"
                    serial += 1
                    state = {"file": name, "tmp": f"{base}/_tmp-{name}-{attempt}", "records": 0, "bytes": 0,
                             "sha": hashlib.sha256(), "first": page, "last": page}
                    out = fs.open_output_stream(state["tmp"], compression=None)
                out.write(member)
                state["records"] += 1
                state["bytes"] += len(member)
                state["sha"].update(member)
                state["last"] = page
        if out is not None:
            rows.append(close())
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                         ["file", "records", "bytes", "sha256", "first_page", "last_page"])
    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least_bytes: int = 100, roll_bytes: int = 8 << 20, shard_bytes: int = 32 << 20,
               date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record for each row under ``path``; ``path/_manifest`` lists the files when the archive is complete."""
    spark = pages.sparkSession
    folder = _qualified(spark, path)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload")).withColumns({
                            "n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    firsts = cut(rows.where(f"n >= {least_bytes} and page_id is not null").groupBy("digest")
                 .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
                 .where("copies > 1").select("digest", F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    revisit = F.col("to").isNotNull() & (F.col("page_id") > F.col("to"))
    rows = rows.join(firsts, "digest", "left").select(
        "page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"), "n", "digest",
        F.when(revisit, F.col("to")).alias("to"), F.when(revisit, F.col("to_url")).alias("to_url"))
    # the empty folder first, by Spark's own means: stores without folders need none, others have it
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    (rows.repartitionByRange(shards, "page_id", "digest").sortWithinPartitions("page_id", "digest")
     .mapInArrow(_writer(folder, roll_bytes, date), _MANIFEST).write.json(f"{folder}/_manifest"))


_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")
_PIECE = 8 << 10


def parse_records(data: bytes):
    """(headers, HTTP headers, payload) of each record of an archive file, member by member.  A member's end is known only
    when it is unpacked, and zlib copies what lies behind it: it gets the file in pieces, not all the rest for each member."""
    data, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while at < len(data) and not z.eof:
            piece = data[at:at + _PIECE]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        record = b"".join(parts)
        end = record.index(b"\r\n\r\n")
        head = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(record[:end + 2])}
        block = record[end + 4:end + 4 + int(head["content-length"])]
        end = block.index(b"\r\n\r\n")
        http = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(block[:end + 2])}
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != head["warc-block-digest"]:
            raise ValueError(f"damaged record {head['warc-record-id']}")
        yield head, http, block[end + 4:]


def _reader(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def number(s):
        return int(s) if s is not None else None

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, http, payload in parse_records(content.as_py()):
                    kind = head["warc-type"]
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    n = int(http["content-length"])
                    if kind == "response":
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), n, digest, kind,
                                 number(head.get("x-refers-to-page-id")),
                                 payload.decode() if with_payload and kind == "response" else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of a complete archive: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    folder = _qualified(spark, path)
    listed = spark.read.schema(_MANIFEST).json(f"{folder}/_manifest").select("file")
    files = (spark.read.schema("path string, modificationTime timestamp, length long, content binary")
             .format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(folder))
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed, "file", "left_semi")
    return files.select("content").mapInArrow(_reader(with_payload), _RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new folder of the shared one and read the archives back, without payloads."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return (read_warc(pages.sparkSession, path, with_payload=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
