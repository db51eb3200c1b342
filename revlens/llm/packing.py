"""Operator 5: packing by order-preserving dynamic programming.

The documents of a Spark partition, in the order of their rows, are one stream
of token ids.  The stream is cut into windows of at most ``width`` tokens.  A
cut may stand at a document's end (free), at a sentence's end (``SENTENCE``
tokens of truncation penalty) or, where neither is within reach, inside a
sentence (``HARD``); a window costs its padding.  The cheapest cuts follow from

    best[j] = penalty[j] + min(best[i] + width - (at[j] - at[i])),  at[j] - at[i] <= width

whose minimum over the sliding range of i is kept in a monotone queue, so the
work is linear in the number of possible cuts.  The stream is handled in
stretches of about ``STRETCH`` tokens: a stretch's last window is not final
and goes on into the next one.  Nothing is shuffled, and a task holds one
stretch and one document at a time.

Sequence ids are unique, and the same when a lost task is run again, since a
scan's partitions are.

Defined cases: a null or empty text is its end id alone; null ids are kept;
repeated rows are packed each by itself; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, slices, string_buffers

SENTENCE, HARD, STRETCH, HARD_STEP = 12, 48, 400_000, 256
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

_SPACE, _LINE = 32, 10
#: bytes that a word table may hold before words not seen lately go
TABLE_BYTES = 32 << 20


def odd_texts(body: np.ndarray, off: np.ndarray, special: list[bytes]) -> np.ndarray:
    """True for texts in which words are not parted by single spaces or line breaks alone, or that hold a special token."""
    n = len(body)
    out = np.zeros(len(off) - 1, bool)
    if n == 0:
        return out
    sep = (body == _SPACE) | (body == _LINE)
    # other white space, as Python's \\s has it, in UTF-8
    bad = ((body >= 9) & (body <= 13) & (body != _LINE)) | ((body >= 0x1C) & (body <= 0x1F))
    after, last = np.append(body[1:], 0), np.concatenate([body[2:], np.zeros(min(2, n), np.uint8)])
    lead = np.flatnonzero((body == 0xC2) | (body == 0xE1) | (body == 0xE2) | (body == 0xE3))
    b0, b1, b2 = body[lead], after[lead], last[lead]
    bad[lead] |= (((b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80))
                  | ((b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)))
                  | ((b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)))
    bad[1:] |= sep[1:] & sep[:-1]                   # at a text's start a separator is odd anyway
    filled = off[1:] > off[:-1]
    bad[off[:-1][filled]] |= sep[off[:-1][filled]]
    bad[off[1:][filled] - 1] |= sep[off[1:][filled] - 1]
    at = np.flatnonzero(bad)
    if special:
        whole = body.tobytes()
        for s in special:
            i = whole.find(s)
            while i >= 0:
                at = np.append(at, i)
                i = whole.find(s, i + 1)
    out[np.searchsorted(off, at, "right") - 1] = True
    return out


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each run, one after the other."""
    begin = np.cumsum(size) - size
    return values[np.repeat(start - begin, size) + np.arange(int(size.sum()))]


class WordTable:
    """Token ids of words by the 64-bit hash of (word, what stands before it), with the words' bytes beside them."""

    def __init__(self, limit: int = TABLE_BYTES):
        self.limit = limit
        self.key, self.used = np.zeros(0, H.U), np.zeros(0, bool)
        self.bytes, self.byte_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._sort()

    def _sort(self) -> None:
        self.order = np.argsort(self.key)
        self.sorted = self.key[self.order]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if absent."""
        if not len(self.sorted):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where(self.sorted[at] == key, self.order[at], -1)

    def same(self, at: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the words at these places have these bytes."""
        size = self.byte_at[at + 1] - self.byte_at[at]
        ok = size == end - start
        i = np.flatnonzero(ok & (size > 0))
        if len(i):
            differ = _gather(self.bytes, self.byte_at[at[i]], size[i]) != _gather(body, start[i], size[i])
            first = np.cumsum(size[i]) - size[i]
            ok[i[np.add.reduceat(differ, first) > 0]] = False
        return ok

    def size(self) -> int:
        return len(self.key) * 33 + len(self.bytes) + 4 * len(self.ids)

    def add(self, key: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        if self.size() > self.limit:                # words not looked up since the last time go
            keep = np.flatnonzero(self.used)
            b, i = np.diff(self.byte_at)[keep], np.diff(self.id_at)[keep]
            self.bytes, self.ids = _gather(self.bytes, self.byte_at[keep], b), _gather(self.ids, self.id_at[keep], i)
            self.byte_at, self.id_at = (np.concatenate([[0], np.cumsum(x)]) for x in (b, i))
            self.key, self.used = self.key[keep], np.zeros(len(keep), bool)
        self.key, self.used = np.concatenate([self.key, key]), np.concatenate([self.used, np.ones(len(key), bool)])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.byte_at = np.concatenate([self.byte_at, self.byte_at[-1] + np.cumsum([len(x) for x in words], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.uint32)])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
        self._sort()


class Encoder:
    """Token ids of whole texts with a table of words.

    The tokenizer's pattern never joins a word with what precedes a single
    space or line break between two non-space characters, so the ids of such a
    text are those of its words, each with its space.  Words are looked up many
    at a time; those that the table lacks go to the tokenizer, as do other texts
    as they are.
    """

    def __init__(self, path: str | None, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable(table_bytes)
        vocab = self.tokenizer.get_vocab()
        self.space, self.line = (np.zeros(max(vocab.values()) + 1, bool) for _ in range(2))
        for token, i in vocab.items():  # in byte-level vocabularies a space is written as one letter, a line break as another
            self.space[i] = token.startswith("Ġ")
            self.line[i] = token.startswith("Ċ")
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        for t in (".", "!", "?", "Ċ"):
            if self.tokenizer.token_to_id(t) is not None:
                self.stops[self.tokenizer.token_to_id(t)] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _joined(self, words: list[str], opens: np.ndarray) -> list[bytes]:
        """Ids of words that each begin with their one space (or line break), many to a call; ``opens`` tells the
        ids that begin with it."""
        out: list[bytes] = []
        for a in range(0, len(words), 512):
            part = words[a:a + 512]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            begin = np.flatnonzero(opens[ids])
            if len(begin) != len(part) or begin[0]:
                out += self._ids(part)
                continue
            data, edge = ids.tobytes(), (np.append(begin, len(ids)) * 4).tolist()
            out += [data[i:j] for i, j in zip(edge, edge[1:])]
        return out

    def _learn(self, key: np.ndarray, kind: np.ndarray, words: list[bytes]) -> None:
        """Put new words into the table; kind 0 opens a text, 1 follows a space, 2 a line break."""
        ids: list[bytes] = [b""] * len(words)
        for k, mark, opens in ((0, "", None), (1, " ", self.space), (2, "\n", self.line)):
            mine = np.flatnonzero(kind == k).tolist()
            texts = [mark + words[i].decode("utf-8", "replace") for i in mine]
            for i, x in zip(mine, self._ids(texts) if opens is None else self._joined(texts, opens)):
                ids[i] = x
        self.table.add(key, words, ids)

    def encode_slice(self, body: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts of a slice."""
        odd = odd_texts(body, off, self.special)
        w = H.split_words(body, off)
        kind = np.where(body[np.maximum(w.start - 1, 0)] == _LINE, 2, 1) if len(w.start) else np.zeros(0, np.int64)
        kind[w.first[:-1][w.first[1:] > w.first[:-1]]] = 0
        key = H.mix(w.hash + kind.astype(H.U) * H.U(0x632BE59BD9B4E019))
        plain = np.flatnonzero(~odd[w.doc])
        distinct, lead, place = np.unique(key[plain], return_index=True, return_inverse=True)
        lead = plain[lead]
        at = self.table.find(distinct)
        new = np.flatnonzero(at < 0)
        self.table.used[at[at >= 0]] = True
        if len(new):
            pick = lead[new]
            text = body.tobytes()
            self._learn(distinct[new], kind[pick], [text[i:j] for i, j in zip(w.start[pick].tolist(), w.end[pick].tolist())])
            at = self.table.find(distinct)
        wrong = ~self.table.same(at, body, w.start[lead], w.end[lead])
        if wrong.any():                              # another word with the same hash: its texts go to the tokenizer
            odd[np.unique(w.doc[plain[wrong[place]]])] = True
        size = np.zeros(len(key), np.int64)
        start = np.zeros(len(key), np.int64)
        start[plain] = self.table.id_at[at][place]
        size[plain] = np.diff(self.table.id_at)[at][place]
        ids = _gather(self.table.ids, start, size)
        edge = np.concatenate([[0], np.cumsum(size)])[w.first]
        out = [ids[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
        left = np.flatnonzero(odd).tolist()
        if left:
            text = body.tobytes()
            for k, x in zip(left, self._ids([text[off[k]:off[k + 1]].decode("utf-8", "replace") for k in left])):
                out[k] = np.frombuffer(x, np.uint32)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        body, off = string_buffers(pa.array(texts, pa.string()))
        return self.encode_slice(body[off[0]:off[-1]], off - off[0]) if texts else []


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Cheapest cuts from at[0] to at[-1]; at must ascend by at most ``width`` a step.  Returns positions."""
    at, penalty = at.tolist(), penalty.tolist()
    came = [0] * len(at)
    queue = deque([(0, 0, 0)])  # (best + at, at, index), ascending in the first
    cost = 0
    for j in range(1, len(at)):
        here = at[j]
        low = here - width
        while queue[0][1] < low:
            queue.popleft()
        least, _, came[j] = queue[0]
        cost = least + width + penalty[j]  # best[j] + at[j]
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, here, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


def _stretch_cuts(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, width: int) -> list[int]:
    """Cuts of a stretch of ids whose documents end at ``ends``."""
    sentence = np.flatnonzero(stops[ids]) + 1
    at = np.concatenate([[0], sentence, ends])
    kind = np.concatenate([[0], np.full(len(sentence), SENTENCE), np.zeros(len(ends), np.int64)])
    wide = np.unique(at)
    gap = np.flatnonzero(np.diff(wide) > width)
    hard = [np.arange(wide[g] + HARD_STEP, wide[g + 1], HARD_STEP) for g in gap]
    if hard:
        hard = np.concatenate(hard)
        at, kind = np.concatenate([at, hard]), np.concatenate([kind, np.full(len(hard), HARD)])
    order = np.lexsort((kind, at))
    at, kind = at[order], kind[order]
    keep = np.r_[True, at[1:] != at[:-1]]
    return best_cuts(at[keep], kind[keep], width)


def _pack(width: int, end_id: int, path: str | None, stretch: int):
    def run(batches):
        enc = encoder(path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        serial = 0
        held: list[tuple] = []  # (doc_id, ids left, start of them, tokens of the document)
        size = 0

        def emit(last: bool):
            nonlocal held, size, serial
            ids = np.concatenate([h[1] for h in held])
            ends = np.cumsum([len(h[1]) for h in held])
            cuts = _stretch_cuts(ids, ends, enc.stops, width)
            if not last and len(cuts) > 1:
                cuts = cuts[:-1]
            stop = cuts[-1]
            edges = np.unique(np.concatenate([[0], ends[ends < stop], cuts]))
            begin, until = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, begin, "right")
            window = np.searchsorted(cuts, begin, "right")
            opened = np.r_[0, cuts][window]
            doc_begin = np.r_[0, ends][doc]
            crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(begin, until)]
            first = np.array([h[2] for h in held])
            yield pa.RecordBatch.from_arrays([
                pa.array([held[d][0] for d in doc], pa.int64()), pa.array(first[doc] + begin - doc_begin),
                pa.array(until - begin), pa.array(crc, pa.int64()), pa.array([held[d][3] for d in doc], pa.int64()),
                pa.array(base + serial + window), pa.array(begin - opened)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            serial += len(cuts)
            rest, at = [], 0
            for d, own, start, n in held:
                if at + len(own) > stop:
                    skip = max(0, stop - at)
                    rest.append((d, own[skip:], start + skip, n))
                at += len(own)
            held, size = rest, sum(len(h[1]) for h in rest)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b, body, off in slices(texts, 2 << 20):
                for d, own in zip(names[a:b], enc.encode_slice(body, off)):
                    held.append((d, np.append(own, np.uint32(end_id)), 0, len(own) + 1))
                    size += len(own) + 1
                    if size >= stretch:
                        yield from emit(False)
        if held:
            yield from emit(True)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 1,
         tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a tokenizers file, the same on all machines;
    by default the public byte-level one.  ``stretch`` is the number of tokens
    that a task cuts at a time.
    """
    bound_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_pack(width, end_id, tokenizer, stretch), PIECES))
