"""Operator 4: toxicity by a factorization machine over hashed terms.

Terms are words (letters and digits, A-Z lower-cased) and their first four and
five bytes, so that inflected forms share a term.  A document's features are
the terms that occur in it, hashed; the machine scores

    b + sum_i w[i] + sum_(i < j) <v[i], v[j]>      over the present terms,

the pairwise part in linear time as half the squared sum less the sum of
squares of the factor vectors.  The factors learn pairs, such as an insult next
to a group's name, that additive weights miss.

Training takes at most ``per_class`` labelled rows of either class (those with
the smallest hash of their id; all rows with a label outside the held-out third
are eligible), weighted back to the class shares counted over all of them.
Features are the hashed terms whose counts differ most between the classes of
that sample, ``features`` at most.  Scoring covers all rows, whole texts, in one
pass without a shuffle; tasks carry the weights of the chosen terms only.

Neither language, source, id nor label is an input of a score.

Defined cases: null or empty texts get the score of a text without terms; a
null id is scored and counts as not held out; labels that are null or whose
document is missing are ignored, repeated labels count once each; with labels
of one class or none all scores are the share of label 1 (0.0 without labels);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, slices

PREFIXES = (4, 5)
BUCKETS = 1 << 22


def _terms(body: np.ndarray, off: np.ndarray):
    """(document, bucket) of the terms of a slice, with repeats."""
    body = H.lower_ascii(body)
    w = H.split_words(body, off, letters=True)
    hashes = [w.hash] + [H.mix(H.word_starts(body, w, k) + H.U(k)) for k in PREFIXES]
    return np.tile(w.doc, len(hashes)), (np.concatenate(hashes) % H.U(BUCKETS)).astype(np.int64)


@dataclass
class Machine:
    """Weights of the chosen buckets; ``chosen`` ascends."""
    chosen: np.ndarray
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def margins(self, doc: np.ndarray, feature: np.ndarray, n_docs: int) -> np.ndarray:
        """Margins of documents from distinct (document, feature) pairs."""
        out = np.full(n_docs, self.bias) + np.bincount(doc, self.weight[feature], n_docs)
        for f in range(self.factors.shape[1]):
            v = self.factors[feature, f]
            total = np.bincount(doc, v, n_docs)
            out += 0.5 * (total * total - np.bincount(doc, v * v, n_docs))
        return out

    def score(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, bucket = _terms(body, off)
        doc, feature = present(doc, bucket, self.chosen)
        return 1 / (1 + np.exp(-np.clip(self.margins(doc, feature, len(off) - 1), -500, 500)))


def present(doc: np.ndarray, bucket: np.ndarray, chosen: np.ndarray):
    """Distinct (document, feature) pairs of the chosen buckets."""
    if not len(chosen) or not len(bucket):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
    hit = chosen[at] == bucket
    pair = np.unique(doc[hit] * np.int64(len(chosen)) + at[hit])
    return pair // len(chosen), pair % len(chosen)


def fit(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, features: int = 4096, rank: int = 8,
        epochs: int = 30, batch: int = 128, rate: float = 0.1, decay: float = 2e-3, least: int = 3,
        seed: int = 7) -> Machine:
    """Machine from the distinct buckets of each row; logistic loss with AdaGrad."""
    share = float(np.average(label, weights=weight)) if len(label) else 0.0
    if not 0 < share < 1:
        empty = np.zeros(0, np.int64)
        # a constant score: an infinite margin has no finite bias
        return Machine(empty, 500.0 if share == 1 else -500.0, np.zeros(0), np.zeros((0, rank)))
    # counted by bucket: sorting all terms of the sample would take several copies of them
    size = max((int(r.max()) + 1 for r in rows if len(r)), default=0)
    count, ones = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for r, one in zip(rows, label):
        count[r] += 1
        ones[r] += one
    terms = np.flatnonzero(count)
    count, ones = count[terms].astype(np.int64), ones[terms].astype(float)
    n1, n0 = label.sum(), len(label) - label.sum()
    p1, p0 = (ones + 0.5) / (n1 + 1), (count - ones + 0.5) / (n0 + 1)
    z = np.abs(np.log(p1 / p0)) / np.sqrt(1 / (ones + 0.5) + 1 / (count - ones + 0.5))
    order = np.argsort(-np.where(count >= least, z, 0), kind="stable")[:features]
    order = np.sort(order[(count[order] >= least) & (z[order] >= 2)])
    chosen = terms[order]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = [place[r] for r in rows]
    held = [f[f >= 0] for f in held]
    rng = np.random.default_rng(seed)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank))
    gw, gv, gb = np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        mixed = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            part = mixed[a:a + batch]
            x = np.zeros((len(part), len(chosen)))
            for i, d in enumerate(part):
                x[i, held[d]] = 1
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            total = x @ v[used]
            margin = bias + x @ w[used] + 0.5 * (total * total - x @ (v[used] ** 2)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label[part]) * weight[part] / len(part)
            dw = x.T @ error + decay * w[used] / len(rows) * batch
            dv = x.T @ (error[:, None] * total) - (x.T @ error)[:, None] * v[used] + decay * v[used] / len(rows) * batch
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(chosen, bias, w, v)


def held_out(id_col: str):
    """True where crc32 of the id as text leaves 1 divided by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _row_terms(batches):
    """Rows (label, text) to (label, distinct buckets)."""
    for batch in batches:
        for a, b, body, off in slices(batch.column(1)):
            doc, bucket = _terms(body, off)
            pair = np.unique(doc * np.int64(BUCKETS) + bucket)
            first = np.searchsorted(pair, np.arange(b - a + 1) * np.int64(BUCKETS))
            bucket = (pair % BUCKETS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a),
                 pa.array([bucket[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = 3000, **options) -> Machine:
    """Machine from a bounded sample of labelled documents outside the held-out third."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class ids, a few dozen KB, go to the tasks
    sample = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("label", "text")
              .mapInArrow(_row_terms, "label int, terms binary").collect())
    sample.sort(key=lambda r: (r.label, bytes(r.terms)))
    label = np.array([r.label for r in sample], np.int64)
    got = np.bincount(label, minlength=2)
    weight = np.array([counts.get(k, 0) / max(1, got[k]) for k in (0, 1)], float)[label] if len(label) else np.zeros(0)
    weight = weight / weight.mean() if len(weight) else weight
    return fit([np.frombuffer(r.terms, np.int32) for r in sample], label, weight, **options)


def score(docs: DataFrame, model: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and a score from 0 to 1."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                text = batch.column(at)
                if not pa.types.is_string(text.type) and not pa.types.is_large_string(text.type):
                    text = text.cast(pa.string())
                s = np.concatenate([model.score(body, off) for _, _, body, off in slices(text)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.7, **options) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted)."""
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return score(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))
