"""Operator 2: substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the indexed blocks of all documents with a
smaller id.  A factor is a run of words that such documents hold; factors of
at least ``window`` words are duplicate spans.

* *Reference blocks*: a document's word windows fall into runs with the same
  anchor, the smallest hash of the word n-grams in a window.  Anchors depend on
  the words alone, so equal passages are cut at equal places wherever they
  stand.  One run is one block of about half a window of starts.
* *Index*: by anchor, the first and the last document that hold it and whether
  all blocks of the anchor are the same (all combined on the map side).
* *Parse*: a block whose anchor the index knows from a smaller id, with one
  content only, is part of a factor as a whole.  Adjoining blocks join to the
  longest factor by themselves, since spans are merged.
* *Factor boundaries*: where an anchor has several contents, a factor starts or
  ends inside the block.  There each window is looked up by itself, in a
  second index of such windows only.

The result is exact: a word is removed when a window that covers it also
starts in a document with a smaller id, all windows judged on the input.

Defined cases: a null text has no words; a row with a null id keeps all its
words and is no reference; rows with the same id don't judge each other, and
each is cut by its own text; repeated equal rows all come back; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, cut, slices

_BLOCKS = "anchor long, block long, doc_id long, text_key long, start int, windows int"
_WINDOWS = "anchor long, word_run long, doc_id long, text_key long, start int"


def _parts(batches):
    """(batch, first row, words, prefix sums) of slices; the text is the last column."""
    for batch in batches:
        for a, b, body, off in slices(batch.column(batch.num_columns - 1)):
            w = H.split_words(body, off)
            yield batch, a, b, w, H.run_prefix(w.hash)


def _blocks(window: int, gram: int):
    """Rows (doc_id, text_key, text) to blocks; a whole text that repeats within the task is one row with no anchor."""
    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch, a, b, w, prefix in _parts(batches):
            ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(w.first)
            whole = H.run_hash(prefix, w.first[:-1], w.first[1:])
            parse = n >= window
            copies = []
            for d in np.flatnonzero(parse):
                key = (int(whole[d]), int(n[d]))
                if seen.get(key, ids[d]) < ids[d]:
                    parse[d] = False
                    copies.append(d)
                else:
                    seen[key] = int(ids[d])
            if len(w.hash) < window:
                continue
            at = np.arange(len(w.hash) - gram + 1)
            low = H.sliding_min(H.run_hash(prefix, at, at + gram), window - gram + 1)
            at = np.arange(len(low))
            doc = w.doc[:len(low)]
            at = at[parse[doc] & (at + window <= w.first[doc + 1])]
            doc, low = w.doc[at], low[at]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.r_[begin, len(at)])
            s, d = at[begin], doc[begin]
            block = H.run_hash(prefix, s, s + count - 1 + window)
            c = np.array(copies, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(low[begin].view(np.int64)), pa.nulls(len(c), pa.int64())]),
                pa.array(np.r_[block.view(np.int64), np.zeros(len(c), np.int64)]),
                pa.array(np.r_[ids[d], ids[c]]), pa.array(np.r_[keys[d], keys[c]]),
                pa.array(np.r_[s - w.first[d], np.zeros(len(c), np.int64)].astype(np.int32)),
                pa.array(np.r_[count, n[c] - window + 1].astype(np.int32))],
                ["anchor", "block", "doc_id", "text_key", "start", "windows"])
    return run


def _spread(arr, first, rows: slice):
    """A list<struct> column's rows as (document index, {field: values}), for the rows of a slice."""
    part = arr.slice(rows.start, rows.stop - rows.start)
    n = np.array([len(x) if x is not None else 0 for x in part], np.int64) if part.null_count else \
        np.diff(part.offsets.to_numpy())
    flat = part.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    return np.repeat(np.arange(len(part)), n), fields


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of begin[i] .. begin[i] + count[i] - 1, one after another."""
    total = int(count.sum())
    out = np.arange(total)
    return out + np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) if total else out


def _windows(window: int):
    """Rows (doc_id, text_key, spans of (start, windows, anchor), text) to their single windows."""
    def run(batches):
        for batch, a, b, w, prefix in _parts(batches):
            doc, f = _spread(batch.column(2), None, slice(a, b))
            if not len(doc):
                continue
            count = f["windows"].astype(np.int64)
            at = _ranges(f["start"].astype(np.int64) + w.first[doc], count)
            row = np.repeat(doc, count)
            ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(f["anchor"], count).astype(np.int64)),
                pa.array(H.run_hash(prefix, at, at + window).view(np.int64)), pa.array(ids[row]), pa.array(keys[row]),
                pa.array((at - w.first[row]).astype(np.int32))],
                ["anchor", "word_run", "doc_id", "text_key", "start"])
    return run


def _cut_words(window: int):
    """Rows (doc_id, spans of (start, windows), text) to (doc_id, n_words, n_removed, kept)."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            step = max(1, min(2000, len(texts)))
            for a in range(0, len(texts), step):
                out = [[], [], []]
                for spans, text in zip(batch.column(1).slice(a, step).to_pylist(), texts.slice(a, step).to_pylist()):
                    words = text.encode().split() if text else []  # bytes: splits at 0x20 and 0x09-0x0D only
                    n = len(words)
                    if spans:
                        gone = np.zeros(n + 1, np.int64)
                        np.add.at(gone, [s["start"] for s in spans], 1)
                        np.add.at(gone, [min(n, s["start"] + s["windows"] - 1 + window) for s in spans], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0)]
                    out[0].append(n)
                    out[1].append(n - len(words))
                    out[2].append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), pa.array(out[0], pa.int64()),
                                                  pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept"])
    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    gram: int = 8) -> DataFrame:
    """Spans of windows that smaller ids hold: (doc_id, text_key, start, windows), all ``windows`` starts from
    word ``start`` on; ``text_key`` is the xxhash64 of the text (for ids that come with several texts)."""
    bound_batches(docs.sparkSession)
    base = _base(docs, id_col, text_col).where("doc_id is not null")
    blocks = base.mapInArrow(_blocks(window, gram), _BLOCKS)
    index = cut(blocks.where("anchor is not null").groupBy("anchor")
                .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                     (F.min("block") == F.max("block")).alias("same"))
                .where("first < last").select("anchor", "first", "same"))
    hits = cut(blocks.join(index, "anchor", "left")
               .where("anchor is null or (same and first < doc_id) or not same")
               .select("anchor", "doc_id", "text_key", "start", "windows", F.coalesce("same", F.lit(True)).alias("same")))
    edges = (hits.where("not same").groupBy("doc_id", "text_key")
             .agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("spans")))
    single = cut(base.join(edges.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "spans", "text")
                 .mapInArrow(_windows(window), _WINDOWS))
    known = cut(single.groupBy("anchor", "word_run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                .where("first < last").select("anchor", "word_run", "first"))
    found = single.join(known, ["anchor", "word_run"]).where("first < doc_id")
    return (hits.where("same").select("doc_id", "text_key", "start", "windows")
            .unionByName(found.select("doc_id", "text_key", "start", F.lit(1).alias("windows"))))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    gram: int = 8) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept), kept words joined by one space."""
    spans = (duplicate_spans(docs, id_col, text_col, window, gram).groupBy("doc_id", "text_key")
             .agg(F.collect_list(F.struct("start", "windows")).alias("spans")))
    base = _base(docs, id_col, text_col)
    return (base.join(spans.hint("merge"), ["doc_id", "text_key"], "left").select("doc_id", "spans", "text")
            .mapInArrow(_cut_words(window), "doc_id long, n_words long, n_removed long, kept string"))
