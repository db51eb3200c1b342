"""Operator 9: benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``2 * half`` words that overlap by half,
longer items into even parts of at most ``2 * half`` words.
Terms are the words of the benchmark (letters and digits, A-Z lower-cased);
their inverse document frequencies are counted over all passages.  Those in
more than ``stop`` of all passages stay out of the reduced space.

* *Randomised SVD*: with the TF-IDF matrix A of all passages (benchmark items
  are rows too, a row for each part, of one length each and ``weight`` times the
  corpus in sum) and a random matrix R of ``rank`` columns, or as many as the
  block has parts, so that the reduced space holds them all, tasks sum A'(A R) over their rows.  The driver gets one
  matrix of terms x rank and takes the leading right singular vectors from it
  (Nystroem's way for A'A).
* *Candidates*: a passage and an item of which a part's rank-reduced vector has
  a cosine of ``cosine`` or more with the passage's (norms are those before the
  reduction).  All passages meet all parts, as one product a slice; none is cut
  off by a top-k.
* *Plain items*: an item that the reduced space holds too little of (``1 -
  share`` of its words or fewer, or under half of its squared TF-IDF length) has
  as candidates all passages around which words that make up ``share`` of it
  occur; no match can have less, so nothing is lost there.
* *Checks*: the whole item's words and the passage's surroundings must have a common
  subsequence of ``share`` of the item.  Where the caller names a column of
  answers, an item's answer must have one of ``answer_share`` there too (items
  with a null or wordless answer need none).  Reworded, thinned out, broken off
  or interrupted copies keep long subsequences; chance hits don't.

The benchmark is taken in blocks of about ``block`` parts, so what tasks are sent
is bounded by that or by the longest item.  Each block takes three passes over the texts and no shuffle of them.

Defined cases: null or empty texts hold nothing; items without words match
nothing; repeated items each match; null ids of documents are returned with
their matches; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, slices

SLICE = 1 << 18  # bytes of text handled at once: each word of the benchmark's takes rank numbers
_PART = 128  # terms in a row of the summed matrix
_MATCHES = "doc_id long, item_id long, cosine double, lcs double"


def _words(body, off):
    return H.split_words(body, off, lower=True, letters=True)


def _lookup(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of each hash among the terms, or -1."""
    if not len(terms) or not len(h):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def _halves(w: H.Words, half: int):
    """(half-passage of each word, document of each half, first half of each document)."""
    n = np.diff(w.first)
    count = -(-n // half)
    first = np.r_[0, np.cumsum(count)]
    own = first[w.doc] + (np.arange(len(w.doc)) - w.first[w.doc]) // half
    return own, np.repeat(np.arange(len(n)), count), first


def _pairs(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each half together with the next one of its document: the passage that begins there."""
    out = x.copy()
    same = np.flatnonzero(doc[1:] == doc[:-1])
    out[same] += x[same + 1]
    return out


def _sums(rows: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by an ascending key."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(key):
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[key[at]] = np.add.reduceat(rows, at, axis=0)
    return out


def _count_terms(terms: np.ndarray, half: int):
    """(term, passages) over all passages; term -1 has the number of passages."""
    def run(batches):
        total, passages = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for _, _, body, off in slices(batch.column(0), SLICE):
                w = _words(body, off)
                own, doc, first = _halves(w, half)
                passages += len(doc)
                t = _lookup(terms, w.hash)
                hit = t >= 0
                # distinct (term, half): a half belongs to the passage that begins there and to the one before, which
                # counts already where the term is in the half before too
                pair = np.unique(t[hit] * np.int64(len(doc) + 1) + own[hit])
                term, h = np.divmod(pair, len(doc) + 1)
                total += np.bincount(term, minlength=len(terms))
                if len(pair):
                    alone = np.r_[True, pair[1:] != pair[:-1] + 1]
                    total += np.bincount(term[alone & (first[doc[h]] < h)], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], passages])], ["term", "n"])
    return run


def _random(seed: int, terms: int, rank: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((terms, rank), np.float32)


def _sketch(terms: np.ndarray, idf: np.ndarray, half: int, rank: int, seed: int):
    """Rows (part, sum) of A'(A R); part -1 has the sum of squares of A."""
    def run(batches):
        weight = idf.astype(np.float32)
        r = _random(seed, len(terms), rank) * weight[:, None]
        z, energy = np.zeros((len(terms), rank), np.float32), 0.0
        for batch in batches:
            for _, _, body, off in slices(batch.column(0), SLICE):
                w = _words(body, off)
                own, doc, first = _halves(w, half)
                t = _lookup(terms, w.hash)
                hit = np.flatnonzero((t >= 0) & (weight[t] > 0)) if len(terms) else np.zeros(0, int)
                if not len(hit):
                    continue
                t, h = t[hit], own[hit]
                p = _pairs(_sums(r[t], h, len(doc)), doc)  # A R, by passage
                energy += float((_pairs(_sums((weight[t] ** 2)[:, None], h, len(doc)), doc)).sum())
                back = p.copy()  # by half: its own passage and the one before
                same = np.flatnonzero(doc[1:] == doc[:-1])
                back[same + 1] += p[same]
                order = np.argsort(t, kind="stable")
                rows = back[h[order]] * weight[t[order]][:, None]
                z += _sums(rows, t[order], len(terms))
        parts = list(range(0, len(terms), _PART))
        yield pa.RecordBatch.from_arrays([
            pa.array([-1] + [a // _PART for a in parts], pa.int32()),
            pa.array([np.float64(energy).tobytes()] + [z[a:a + _PART].tobytes() for a in parts], pa.binary())],
            ["part", "sum"])
    return run


def _add_parts(key, table):
    kind = np.float64 if key[0].as_py() == -1 else np.float32
    total = None
    for b in table.column("sum"):
        own = np.frombuffer(b.as_buffer(), kind).astype(np.float64)
        total = own if total is None else total + own
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sum": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Searcher:
    """What a task needs to find a block of items; bounded by the block and the rank."""
    terms: np.ndarray     # ascending hashes of the benchmark's words
    latent: np.ndarray    # terms x rank: right singular vectors, weighted by idf
    weight: np.ndarray    # idf, 0 outside the reduced space
    ids: np.ndarray       # item ids
    words: list           # hashes of each item's words
    vectors: np.ndarray   # parts x rank, divided by the norms before the reduction
    part_of: np.ndarray   # item of each part, ascending
    half: int
    cosine: float
    share: float
    answers: list         # hashes of each answer's words; none where there is no answer
    answer_share: float
    plain: np.ndarray     # items that the reduced space holds too little of

    def _plain_places(self, item: int, t, h, doc, first) -> np.ndarray:
        """Passages around which words that make up ``share`` of a plain item occur; t, h are sorted by both."""
        words = self.words[item]
        times = np.zeros(len(self.terms))
        np.add.at(times, np.searchsorted(self.terms, words), 1)
        at = np.flatnonzero(times[t] > 0)
        if not len(at):
            return at
        t, h = t[at], h[at]
        # an occurrence counts for the passages of its document whose surroundings reach it, once for a word
        reach = -(-len(words) // self.half)
        d = doc[h]
        begin = np.maximum(h - 1 - reach, first[d])
        end = np.minimum(h + reach, first[d + 1] - 1) + 1
        again = np.flatnonzero(t[1:] == t[:-1]) + 1
        begin[again] = np.maximum(begin[again], end[again - 1])
        held = np.cumsum(np.bincount(begin, times[t], len(doc) + 1) - np.bincount(end, times[t], len(doc) + 1))
        return np.flatnonzero(held[:-1] >= self.share * len(words) - 1e-6)

    def matches(self, body: np.ndarray, off: np.ndarray):
        """(document, item, cosine, lcs) of the best matching place of each pair in a slice."""
        w = _words(body, off)
        own, doc, first = _halves(w, self.half)
        t = _lookup(self.terms, w.hash)
        known = np.flatnonzero(t >= 0)
        if not len(known):
            return []
        best: dict[tuple[int, int], tuple[float, float]] = {}

        def check(place, item, cos):
            d = int(doc[place])
            words = self.words[item]
            begin = w.first[d] + (place - first[d]) * self.half
            reach = slice(max(w.first[d], begin - len(words)), min(w.first[d + 1], begin + 2 * self.half + len(words)))
            near = w.hash[reach]
            held = near[t[reach] >= 0]  # other words are in no item
            if len(held) < self.share * len(words) - 1e-6:
                return
            common = lcs_share(words, held)
            if common < self.share:
                return
            if len(self.answers[item]) and lcs_share(self.answers[item], near) < self.answer_share:
                return
            key = (d, int(item))
            best[key] = max(best.get(key, (0.0, 0.0)), (common, cos))

        hit = known[self.weight[t[known]] > 0]
        p = _pairs(_sums(self.latent[t[hit]], own[hit], len(doc)), doc)
        norm = np.sqrt(_pairs(_sums((self.weight[t[hit]] ** 2)[:, None], own[hit], len(doc)), doc)[:, 0])
        filled = np.flatnonzero(norm > 0)
        begins = np.searchsorted(self.part_of, np.arange(len(self.ids)))  # each item has a part at least
        for a in range(0, len(filled), 4096):
            rows = filled[a:a + 4096]
            cos = (p[rows] @ self.vectors.T) / norm[rows][:, None]
            if len(self.part_of) > len(self.ids):
                cos = np.maximum.reduceat(cos, begins, axis=1)  # by item, the best of its parts
            for i, item in zip(*np.nonzero((cos >= self.cosine) & ~self.plain)):
                check(rows[i], item, float(cos[i, item]))
        if self.plain.any():
            known = known[np.argsort(t[known], kind="stable")]
            for item in np.flatnonzero(self.plain):
                parts = self.vectors[self.part_of == item]
                for place in self._plain_places(item, t[known], own[known], doc, first):
                    check(place, item, float((parts @ p[place]).max() / norm[place]) if norm[place] > 0 else 0.0)
        return [(d, i, cos, common) for (d, i), (common, cos) in sorted(best.items())]


def lcs_share(words: np.ndarray, near: np.ndarray) -> float:
    """Length of the longest common subsequence as a share of ``words`` (bit-parallel rows)."""
    if not len(words):
        return 0.0
    places: dict[int, int] = {}
    for k, x in enumerate(words.tolist()):
        places[x] = places.get(x, 0) | (1 << k)
    full = (1 << len(words)) - 1
    row = full
    for x in near.tolist():
        m = places.get(x)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return (len(words) - row.bit_count()) / len(words)


def _hashes(text: str | None) -> np.ndarray:
    body = (text or "").encode()
    return _words(np.frombuffer(body, np.uint8), np.array([0, len(body)])).hash


def _items(rows) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    ids, words, answers = [], [], []
    for r in rows:
        own = _hashes(r.text)
        if len(own):
            ids.append(r.item_id)
            words.append(own)
            answers.append(_hashes(r.answer))
    return np.array(ids, dtype=object), words, answers


def fit(docs: DataFrame, rows, text_col: str = "text", half: int = 32, rank: int = 144, stop: float = 0.02,
        cosine: float = 0.2, weight: float = 10.0, share: float = 0.6, answer_share: float = 0.4, seed: int = 11) -> Searcher:
    """Searcher for a block of items (rows with item_id, text and answer)."""
    ids, words, answers = _items(rows)
    terms = np.unique(np.concatenate(words)) if words else np.zeros(0, H.U)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = {r.term: r.n for r in texts.mapInArrow(_count_terms(terms, half), "term long, n long")
              .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a number for each term of the block
    passages = counts.get(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(len(terms))], float)
    idf = np.log((passages + len(words) + 1) / (df + 1))
    stopped = df > stop * max(passages, 10)
    part_of = np.repeat(np.arange(len(words)), [-(-len(w) // (2 * half)) for w in words])
    parts = [x for w in words for x in np.array_split(w, -(-len(w) // (2 * half)))]
    items = np.zeros((len(parts), len(terms)))
    for i, w in enumerate(parts):
        np.add.at(items[i], np.searchsorted(terms, w), 1)

    def by_item(x):
        return np.bincount(part_of, x, len(words))

    held = by_item((items * ~stopped).sum(axis=1)) / np.maximum(by_item(items.sum(axis=1)), 1)
    items *= idf
    whole = by_item((items ** 2).sum(axis=1))
    idf[stopped] = 0.0
    items[:, stopped] = 0.0
    plain = (held <= 1 - share + 1e-9) | (by_item((items ** 2).sum(axis=1)) < 0.5 * whole)
    rank = max(1, min(max(rank, len(parts)), len(terms)))
    z, energy = np.zeros((len(terms), rank)), 0.0
    if len(terms):
        found = (texts.mapInArrow(_sketch(terms, idf, half, rank, seed), "part int, sum binary")
                 .groupBy("part").applyInArrow(_add_parts, "part int, sum binary").collect())  # terms x rank numbers
        for r in found:
            if r.part == -1:
                energy = float(np.frombuffer(r["sum"])[0])
            else:
                own = np.frombuffer(r["sum"]).reshape(-1, rank)
                z[r.part * _PART:r.part * _PART + len(own)] = own
        unit = items / np.maximum(np.sqrt((items ** 2).sum(axis=1)), 1e-12)[:, None]
        scale = weight * max(energy, 1.0) / max((unit ** 2).sum(), 1e-9)
        r = _random(seed, len(terms), rank).astype(float)
        z += scale * unit.T @ (unit @ r)
        core = r.T @ z
        value, vector = np.linalg.eigh((core + core.T) / 2)
        keep = value > 1e-9 * max(value.max(), 1e-300)
        factor = z @ (vector[:, keep] / np.sqrt(value[keep]))
        basis = np.linalg.svd(factor, full_matrices=False)[0] if keep.any() else np.zeros((len(terms), 1))
    else:
        basis = np.zeros((0, 1))
    norm = np.sqrt((items ** 2).sum(axis=1))
    vectors = (items @ basis) / np.maximum(norm, 1e-12)[:, None]
    return Searcher(terms, (basis * idf[:, None]).astype(np.float32), idf.astype(np.float32), ids, words,
                    vectors.astype(np.float32), part_of, half, cosine, share, answers, answer_share, plain)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None, block: int,
            half: int = 32, **_):
    """The benchmark's rows, as many at a time as have about ``block`` parts."""
    bound_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"),
                            (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"))
    n_parts = rows.agg(F.sum(F.ceil(n_words / (2 * half)))).first()[0] or 0
    n = max(1, -(-n_parts // block))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield part.orderBy("item_id", "text", "answer").collect()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, block: int = 200,
                  **options) -> DataFrame:
    """One row per document and item that it holds: (doc_id, item_id, cosine, lcs)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for rows in _blocks(benchmark, item_col, item_text_col, answer_col, block, **options):
        s = fit(base, rows, "text", **options)

        def run(batches, s=s):
            for batch in batches:
                for a, b, body, off in slices(batch.column(1), SLICE):
                    m = s.matches(body, off)
                    if m:
                        d, i, cos, common = (np.array(x) for x in zip(*m))
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).slice(a, b - a).take(pa.array(d)),
                            pa.array([s.ids[k] for k in i], pa.int64()), pa.array(cos), pa.array(common)],
                            ["doc_id", "item_id", "cosine", "lcs"])

        part = base.mapInArrow(run, _MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", answer_col: str | None = None, block: int = 200,
                  **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index(text_col)
    out = docs
    for rows in _blocks(benchmark, item_col, item_text_col, answer_col, block, **options):
        s = fit(docs, rows, text_col, **options)

        def run(batches, s=s):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, b, body, off in slices(batch.column(at), SLICE):
                    for d, *_ in s.matches(body, off):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, StructType(docs.schema.fields))
    return out
