"""Vectorised words and word n-grams of whole texts, as 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Hashes of
words and of word n-grams are polynomial prefix sums modulo 2**64 (so that any
run of bytes or words is one subtraction and one product), finished with a
bijective mixer.  The values depend on the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown as needed."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _TABLES[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a slice of documents: byte range, document and hash of each;
    ``first[d]:first[d + 1]`` are document d's words."""
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _byte_prefix(body, up):
    prefix = np.zeros(len(body) + 1, U)
    np.cumsum((body.astype(U) + U(1)) * up[:len(body)], out=prefix[1:])
    return prefix


def _byte_hash(prefix, down, start, end):
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(U) * U(0xA24BAED4963EE407))


def word_starts(body: np.ndarray, w: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word (of the whole word if shorter)."""
    if len(body) == 0:
        return np.zeros(0, U)
    up, down = _powers(_BYTE_BASE, len(body) + 1)
    return _byte_hash(_byte_prefix(body, up), down, w.start, np.minimum(w.end, w.start + size))


def lower_ascii(body: np.ndarray) -> np.ndarray:
    return np.where((body >= 65) & (body <= 90), body + np.uint8(32), body)


def split_words(body: np.ndarray, off: np.ndarray, lower: bool = False, letters: bool = False) -> Words:
    """Words of a slice; with ``letters`` all ASCII but letters and digits parts them too."""
    n_docs = len(off) - 1
    if lower:
        body = lower_ascii(body)
    n = len(body)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U), np.zeros(n_docs + 1, np.int64))
    if letters:
        low = body | np.uint8(32)
        word = (body >= 128) | ((low >= 97) & (low <= 122)) | ((body >= 48) & (body <= 57))
    else:
        word = ~((body == 32) | ((body >= 9) & (body <= 13)))
    edge = np.unique(off)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    up, down = _powers(_BYTE_BASE, n + 1)
    h = _byte_hash(_byte_prefix(body, up), down, start, end)
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(start, end, doc, h, first)


def run_prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over word hashes for :func:`run_hash`."""
    up, down = _powers(_WORD_BASE, len(h) + 1)
    prefix = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[:len(h)], out=prefix[1:])
    return prefix, down


def run_hash(prefix, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the word runs [begin, stop)."""
    p, down = prefix
    h = (p[stop] - p[begin]) * down[begin]
    return mix(h + (stop - begin).astype(U) * U(0x9FB21C651E98DF25))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values (len(a) - width + 1 results)."""
    m, span = a, 1
    while span * 2 <= width:
        m = np.minimum(m[:len(m) - span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def shingle_sets(body: np.ndarray, off: np.ndarray, size: int = 5):
    """Distinct word shingles of each document (lower-cased A-Z).

    A document with fewer than ``size`` words has its whole sequence as one
    shingle; one without words has none.  Returns (hashes sorted within each
    document, first index per document).
    """
    w = split_words(body, off, lower=True)
    n_docs = len(off) - 1
    count = np.diff(w.first)
    prefix = run_prefix(w.hash)
    i = np.arange(len(w.hash))
    stop = w.first[w.doc + 1] if len(i) else i
    full = i + size <= stop
    short = (count[w.doc] < size) & (i == w.first[w.doc]) if len(i) else np.zeros(0, bool)
    pick = np.flatnonzero(full | short)
    h = run_hash(prefix, pick, np.minimum(pick + size, stop[pick]))
    doc = w.doc[pick]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    order = np.argsort(doc.astype(np.int32), kind="stable")
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))
