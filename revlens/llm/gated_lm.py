"""Operator 11: language-model scoring with a gated recurrent network.

Tokens are words (A-Z lower-cased) and one end per text.  The network is a gated
recurrent unit in numpy whose input and output know ``softmax_words`` frequent
words, the end, and ``SHAPES`` shapes that stand for all other words.  Its output
is factored by class: P(class | state) * P(word | class, state), with frequent
words in classes of ``CLASS`` by falling count; a shape is a class of its own, in
which a word has the discounted share of its count among all words of the shape,
and all unseen words together have what the discount leaves.  These shares need
the exact counts of all words of the corpus.

Training is backpropagation through windows of ``window`` tokens with the state
carried on, over every window of every training document.  Documents are dealt
to ``rounds`` parts by the hash of their id; in a round each task starts from the
common weights, learns from its own documents and returns its weights, which are
averaged by tokens in two steps (``GROUPS`` tasks, then the driver).  Scoring
carries the state through the whole document.

What grows with the corpus stays in Spark: words are counted by a grouped sum,
and the words of a document that are not among the ``head`` most frequent ones
meet their counts in a join.  Texts are read twice, to count words and to write
each document's token ids, from which training and scoring go on.  A task holds
the network, the head (a 64-bit hash and a count for each word) and one Arrow
batch.  Head words are told apart by their hash, all others by their bytes.

Defined cases: a null or empty text is its end alone; a null id is not held out
and is learnt from; rows with equal ids are scored each by itself, and equal
texts alike but for rounding; without training documents all words are unseen
and the network keeps its first weights; an empty table gives an empty result;
further columns are ignored, names may clash.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import hashing as H
from revlens.llm.common import bound_batches, cut, reuse_memory, slices

CLASS, SHAPES, GROUPS = 64, 24, 64
END = 0  # its id


# words

def shapes(body: np.ndarray, w: H.Words) -> np.ndarray:
    """Shape of each word: length band, punctuation at its end, digits or bytes beyond ASCII in it."""
    def has(mask):
        total = np.zeros(len(body) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[w.end] > total[w.start]

    if not len(w.start):
        return np.zeros(0, np.int16)
    low = body | np.uint8(32)
    digit = (body >= 48) & (body <= 57)
    high = body >= 128
    last = w.end - 1
    punct = ~(digit[last] | high[last] | ((low[last] >= 97) & (low[last] <= 122)))
    kind = np.where(has(digit), 2, np.where(has(high), 1, 0))
    band = np.searchsorted(np.array([5, 8, 12]), w.end - w.start, "left")
    return (kind * 8 + punct * 4 + band).astype(np.int16)


def word_bytes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as an Arrow array of binary values."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[at]))])


def _shaped(body: np.ndarray, w: H.Words, pick: np.ndarray):
    """(words, shapes) of some words of a slice."""
    words = word_bytes(body, w.start[pick], w.end[pick])
    edge = np.frombuffer(words.buffers()[1], np.int32)
    each = H.Words(edge[:-1], edge[1:], pick, w.hash[pick], w.first)  # one after the other
    return words, shapes(np.frombuffer(words.buffers()[2], np.uint8), each)


def _distinct(body: np.ndarray, w: H.Words, pick: np.ndarray):
    """(hashes, words, shapes, counts) of the distinct ones among some words of a slice."""
    h = w.hash[pick]
    order = np.argsort(h)
    h = h[order]
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[:len(h)])
    return h[lead], *_shaped(body, w, pick[order[lead]]), np.diff(lead, append=len(h))


def _count(batches):
    """(text) to (word, shape, n): the words of each slice with their counts.  Words of a task's first slice, most of
    all that come, are added up over the task; in a task words are told apart by their hash."""
    def rows(words, kind, n):
        return pa.RecordBatch.from_arrays([words, pa.array(kind.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])

    look = None
    for batch in batches:
        for _, _, body, off in slices(batch.column(0), 2 << 20):
            body = H.lower_ascii(body)
            w = H.split_words(body, off)
            pick = np.arange(len(w.hash))
            if look is None:
                h, words, kind, total = _distinct(body, w, pick)
                look = Lookup(h)
            else:
                at = look(w.hash)
                total += np.bincount(at[at >= 0], minlength=len(total))
                _, *rest = _distinct(body, w, pick[at < 0])
                yield rows(*rest)
    if look is not None:
        yield rows(words, kind, total)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 divided by 7."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


class Lookup:
    """Place of 64-bit hashes in a list of distinct ones, -1 if absent: one probe of a direct table, and a binary
    search among the few that share a slot."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys) * 8).bit_length())
        self.shift, self.keys = H.U(64 - bits), keys
        slot = (keys >> self.shift).astype(np.int64)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        out = np.flatnonzero(self.table[slot] != np.arange(len(keys)))
        self.rest = out[np.argsort(keys[out])]
        self.rest_keys = keys[self.rest]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = self.table[(h >> self.shift).view(np.int64)]
        miss = np.flatnonzero(self.keys[at] != h)  # at -1 too: the last key has a slot that is not empty
        shared = miss[at[miss] >= 0]  # no key of an empty slot is in the rest
        at[miss] = -1
        if len(self.rest):
            p = np.minimum(np.searchsorted(self.rest_keys, h[shared]), len(self.rest) - 1)
            hit = self.rest_keys[p] == h[shared]
            at[shared[hit]] = self.rest[p[hit]]
        return at


# the network

@dataclass
class Network:
    """Weights; words 0 .. n_words - 1 are the end and the frequent words, by class; then come the shapes."""
    n_words: int
    w: dict = field(default_factory=dict)

    def __post_init__(self):
        self.classes = self.class_of(np.arange(self.n_words + SHAPES))

    @property
    def n_classes(self) -> int:
        return -(-self.n_words // CLASS) + SHAPES

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_words, ids // CLASS, ids - self.n_words + self.n_classes - SHAPES).astype(np.int16)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def parts(self, values: np.ndarray) -> dict:
        """The arrays that lie one after the other in ``values``, without copying."""
        out, i = {}, 0
        for k, a in self.w.items():
            out[k] = values[i:i + a.size].reshape(a.shape)
            i += a.size
        return out

    def filled(self, values: np.ndarray) -> "Network":
        return Network(self.n_words, {k: a.astype(self.w[k].dtype) for k, a in self.parts(values).items()})


def network(counts: np.ndarray, shape_counts: np.ndarray, size: int = 16, seed: int = 11, kind=np.float32) -> Network:
    """First weights: random, and output biases that give the words' shares without looking at the state."""
    rng = np.random.default_rng(seed)
    net = Network(len(counts))
    c = net.class_of(np.arange(len(counts) + SHAPES))
    n = np.concatenate([counts, shape_counts]) + 0.5
    mass = np.bincount(c, n)
    # the last row of "c" and the last column of "o" are the biases
    net.w = {k: a.astype(kind) for k, a in {
        "in": rng.normal(0, 0.3, (len(n), 3 * size)), "u": rng.normal(0, 1 / math.sqrt(size), (size, 3 * size)),
        "c": np.vstack([rng.normal(0, 0.05, (size, net.n_classes)), np.log(mass / mass.sum())]),
        "o": np.column_stack([rng.normal(0, 0.05, (len(counts), size)), np.log(n[:len(counts)] / mass[c[:len(counts)]])])}.items()}
    return net


def streams(length: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to at most ``most`` streams of near equal length, the longest stream first."""
    order = np.argsort(-length, kind="stable")
    heap = [(0, i) for i in range(min(most, len(length)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in order.tolist():
        n, i = heap[0]
        heapq.heapreplace(heap, (n + int(length[d]), i))
        out[i].append(d)
    return [out[i] for _, i in sorted(heap, key=lambda x: (-x[0], x[1]))]


@dataclass
class Stream:
    """Tokens of a batch of documents, laid out step after step: the first token of each stream, the second of each ..."""
    ids: np.ndarray       # the token to predict
    before: np.ndarray    # the token before it (the end, at a document's start)
    start: np.ndarray     # true at a document's start
    doc: np.ndarray
    length: np.ndarray    # of the streams, falling


def lay_out(ids: np.ndarray, first: np.ndarray, most: int) -> Stream:
    """``ids[first[d]:first[d + 1]]`` are document d's tokens (never none)."""
    size = np.diff(first)
    dealt = streams(size, most)
    order = np.array([d for s in dealt for d in s], np.int64)
    n = size[order]
    begin = np.cumsum(n) - n
    at = np.repeat(first[order] - begin, n) + np.arange(n.sum())
    ids = ids[at]
    before, start = np.empty_like(ids), np.zeros(len(ids), bool)
    before[1:] = ids[:-1]
    before[begin], start[begin] = END, True
    length = np.array([size[s].sum() for s in dealt], np.int64)
    # streams that reach a step are the first ones, so their tokens lie there in the order of the streams
    step = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
    reach = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    place = (np.cumsum(reach) - reach)[step] + np.repeat(np.arange(len(length)), length)

    def by_step(values):
        out = np.empty_like(values)
        out[place] = values
        return out

    return Stream(by_step(ids), by_step(before), by_step(start), by_step(np.repeat(order.astype(np.int32), n)), length)


def steps(s: Stream, window: int, tokens: int = 0):
    """Windows: for each, the range of its tokens and the number of streams that reach each step.  Where few streams are
    left, a window has more steps, as long as it has no more than so many ``tokens``."""
    t, at, last = 0, 0, int(s.length[0]) if len(s.length) else 0
    while t < last:
        n = max(window, tokens // int(np.searchsorted(-s.length, -t, "left"))) if tokens else window
        active = np.searchsorted(-s.length, -np.arange(t, min(t + n, last)), "left")
        size = int(active.sum())
        yield slice(at, at + size), active
        t, at = t + len(active), at + size


def _starts(s: Stream, index: slice, edge: list) -> list:
    """Streams that begin a document, for each step of a window."""
    at = np.flatnonzero(s.start[index])
    cuts = np.searchsorted(at, edge).tolist()
    return [at[a:b] - i if a < b else None for a, b, i in zip(cuts, cuts[1:], edge)]


def by_gate(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the input and of the state, one block for each gate (those of the two gates' inputs negated) and one
    for the new state."""
    n = net.w["u"].shape[0]
    embed, u = (np.ascontiguousarray(net.w[k].reshape(-1, 3, n).transpose(1, 0, 2)) for k in ("in", "u"))
    np.negative(embed[:2], out=embed[:2])
    return embed, u


def forward(net: Network, s: Stream, index: slice, active: np.ndarray, h: np.ndarray, weights=None, keep: bool = True):
    """States after each token before the predicted ones, and with ``keep`` what going back needs.  A step's gates and
    inner state lie in one block, the same for all steps.  ``weights`` are those of :func:`by_gate`, for many windows
    with the same network."""
    n = h.shape[1]
    embed, u = weights or by_gate(net)
    edge = np.concatenate([[0], np.cumsum(active)]).tolist()
    starts = _starts(s, index, edge)
    before = s.before[index].astype(np.intp)
    out = np.empty((edge[-1], n), h.dtype)
    prev, new, mixed = (np.empty(x + (edge[-1], n), h.dtype) if keep else None for x in ((), (), (3,)))
    block = np.empty((3, edge[1], n), h.dtype)
    for i, j, fresh in zip(edge, edge[1:], starts):
        p = h[:j - i]
        if fresh is not None:
            p = p.copy()
            p[fresh] = 0
        if j - i < block.shape[1]:
            block = np.empty((3, j - i, n), h.dtype)
        z, m = block[:2], block[2]
        x = embed.take(before[i:j], axis=1)
        np.matmul(p, u, out=block)
        np.subtract(x[:2], z, out=z)
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        if keep:
            prev[i:j], mixed[:, i:j] = p, block
            m = new[i:j]
        np.multiply(z[1], block[2], out=m)
        m += x[2]
        np.tanh(m, out=m)
        h = np.subtract(p, m, out=out[i:j])
        h *= z[0]
        h += m
    return out, (prev, mixed, new, edge, starts)


def outputs(net: Network, states: np.ndarray, ids: np.ndarray, grads: dict | None = None):
    """Log probability of each token; with ``grads`` their derivatives are added there and those of the states returned."""
    w, size = net.w, states.shape[1]
    hs = np.ones((len(states), size + 1), states.dtype)
    hs[:, :size] = states

    def softmax(p, target):
        """Log probability of the targets by logits, which become their derivatives; ``Adam`` keeps weights so small that
        no logit overflows."""
        at = np.arange(len(target)) * p.shape[1] + target
        flat = p.ravel()
        chosen = flat.take(at)
        np.exp(p, out=p)
        total = p.sum(axis=1)
        if grads is not None:
            p /= total[:, None]
            flat[at] -= 1
        return np.subtract(chosen, np.log(total, out=total), out=chosen)

    c, p = net.classes.take(ids), hs @ w["c"]
    logp = softmax(p, c)
    back = None
    if grads is not None:
        grads["c"] += hs.T @ p
        back = p @ w["c"][:size].T
    # the tokens with a class of several words, class after class; classes of one width are one softmax
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c.take(order), np.arange(net.n_classes - SHAPES + 1)).tolist()
    order = order[:edge[-1]]
    hs, target = hs.take(order, axis=0), ids.take(order) % CLASS
    within = np.empty(len(order), logp.dtype)
    more = np.empty((len(order), size), logp.dtype) if grads is not None else None
    full = net.n_words // CLASS
    for classes in (range(full), range(full, len(edge) - 1)):
        some = [(edge[k], edge[k + 1], k * CLASS, min((k + 1) * CLASS, net.n_words)) for k in classes if edge[k] < edge[k + 1]]
        if not some:
            continue
        at = slice(some[0][0], some[-1][1])
        first = at.start
        p = np.empty((at.stop - first, some[0][3] - some[0][2]), logp.dtype)
        for i, j, a, b in some:
            np.matmul(hs[i:j], w["o"][a:b].T, out=p[i - first:j - first])
        within[at] = softmax(p, target[at])
        if grads is not None:
            for i, j, a, b in some:
                own = p[i - first:j - first]
                grads["o"][a:b] += own.T @ hs[i:j]
                np.matmul(own, w["o"][a:b, :size], out=more[i:j])
    logp[order] += within
    if grads is not None:
        more += back.take(order, axis=0)
        back[order] = more
    return logp, back


def backward(net: Network, s: Stream, index: slice, saved, back: np.ndarray, grads: dict) -> None:
    """Derivatives through the window's steps, added to ``grads``; the state at its start is given."""
    prev, mixed, new, edge, starts = saved
    n = prev.shape[1]
    ut = np.ascontiguousarray(net.w["u"].T)
    gate, (z, r, inner) = mixed[:2], mixed
    slope, to_n = 1 - gate, new * new
    np.subtract(1, to_n, out=to_n)
    to_n *= slope[0]
    slope *= gate
    to_z, to_r = slope
    to_z *= prev - new
    to_r *= inner
    dg = np.empty((len(prev), 3 * n), prev.dtype)
    dn = np.empty((len(prev), n), prev.dtype)
    dh = np.zeros((edge[1], n), prev.dtype)
    for i, j, fresh in zip(edge[-2::-1], edge[:0:-1], starts[::-1]):
        d = back[i:j]
        d[:min(j - i, len(dh))] += dh[:j - i]
        dm = np.multiply(d, to_n[i:j], out=dn[i:j])
        g = dg[i:j]
        np.multiply(d, to_z[i:j], out=g[:, :n])
        np.multiply(dm, to_r[i:j], out=g[:, n:2 * n])
        np.multiply(dm, r[i:j], out=g[:, 2 * n:])
        dh = g @ ut
        d *= z[i:j]
        dh += d
        if fresh is not None:
            dh[fresh] = 0
    grads["u"] += prev.T @ dg
    dg[:, 2 * n:] = dn
    before = s.before[index]
    order = np.argsort(before, kind="stable")
    sorted_ids = before.take(order)
    cuts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    grads["in"][sorted_ids[cuts]] += np.add.reduceat(dg.take(order, axis=0), cuts, axis=0)


class Adam:
    """Steps of all weights at once; the network's arrays become parts of one."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.all = net.flat()
        net.w = net.parts(self.all)
        self.grads, self.m, self.v, self.a, self.b = (np.zeros_like(self.all) for _ in range(5))

    def step(self, tokens: int) -> None:
        self.t += 1
        fix = math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        g, m, v, a, b = self.grads, self.m, self.v, self.a, self.b
        g /= tokens
        np.clip(g, -0.1, 0.1, out=g)
        m += np.multiply(np.subtract(g, m, out=a), 0.1, out=a)
        v += np.multiply(np.subtract(np.multiply(g, g, out=a), v, out=a), 0.001, out=a)
        np.add(np.sqrt(v, out=a), 1e-8, out=a)
        self.all -= np.divide(np.multiply(m, self.rate * fix, out=b), a, out=b)
        g[:] = 0
        for k, bias in (("c", self.net.w["c"][-1]), ("o", self.net.w["o"][:, -1])):
            kept = np.maximum(bias, -20)  # a class or word that is never seen needs no less
            np.clip(self.net.w[k], -2.5, 2.5, out=self.net.w[k])
            bias[:] = np.minimum(kept, 20)


def learn(net: Network, opt: Adam, ids: np.ndarray, first: np.ndarray, window: int, most: int) -> None:
    """One pass over a batch of documents."""
    s = lay_out(ids, first, most)
    h = np.zeros((len(s.length), net.w["u"].shape[0]), net.w["u"].dtype)
    grads = net.parts(opt.grads)
    for index, active in steps(s, window):
        states, saved = forward(net, s, index, active, h)
        _, back = outputs(net, states, s.ids[index], grads)
        h = states[len(states) - active[-1]:].copy()
        backward(net, s, index, saved, back, grads)
        opt.step(len(back))


def likelihood(net: Network, ids: np.ndarray, first: np.ndarray, window: int, most: int) -> np.ndarray:
    """Sum of the log probabilities of each document's tokens, the state carried through the whole document."""
    s = lay_out(ids, first, most)
    h = np.zeros((len(s.length), net.w["u"].shape[0]), net.w["u"].dtype)
    total, weights = np.zeros(len(first) - 1), by_gate(net)
    for index, active in steps(s, window, window * most):
        states, _ = forward(net, s, index, active, h, weights, keep=False)
        logp, _ = outputs(net, states, s.ids[index])
        h = states[len(states) - active[-1]:]
        total += np.bincount(s.doc[index], logp, len(total))
    return total


# Spark jobs

@dataclass
class Counts:
    """What the driver knows of the training tokens.

    ``head`` holds the hashes of the frequent words by falling count and ``c`` their counts;
    the first ``softmax`` of them are words of the network.  Of the words that are not, ``total`` is the
    count by shape, ``kinds`` the number of words and ``ones`` and ``twos`` of those seen once and twice.
    """
    n: int
    v: int
    docs: int
    head: np.ndarray
    c: np.ndarray
    head_shape: np.ndarray
    softmax: int
    total: np.ndarray
    discount: np.ndarray
    unseen: np.ndarray

    @property
    def base(self) -> float:
        return float(self.n + self.v + 1)

    @property
    def kind(self):
        """Type of a packed token id."""
        return np.int16 if self.softmax + 1 + SHAPES < 32768 else np.int32


def _hashes(words: list[bytes]) -> np.ndarray:
    body = np.frombuffer(b" ".join(words), np.uint8)  # a word holds no space
    return H.split_words(body, np.array([0, len(body)])).hash


def count(docs: DataFrame, softmax_words: int, head: int) -> tuple[Counts, DataFrame]:
    """(what the driver knows, (word, c) of all words that are not in the head) of a table (text)."""
    words = (docs.select("text").mapInArrow(_count, "word binary, shape int, n long")
             .groupBy("word", "shape").agg(F.sum("n").alias("c"))
             .withColumn("band", F.floor(F.log2("c") * 8).cast("int")))
    words = cut(words)
    seen = docs.select(F.lit(1)).count()
    bands = words.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c")).collect()  # 500 rows at most
    least, held = 1 << 30, 0
    for b in sorted(bands, key=lambda b: -b.band):
        if held + b.k > head:
            break
        least, held = b.band, held + b.k
    top = words.where(F.col("band") >= least).select("word", "shape", "c").collect()  # ``head`` rows at most
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    tail = words.where(F.col("band") < least)
    stats = np.zeros((4, SHAPES))
    for r in (tail.groupBy("shape").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("c") == 1).alias("a"),
                                        F.count_if(F.col("c") == 2).alias("b")).collect()):  # a row for each shape
        stats[:, r["shape"]] = r.t, r.k, r.a, r.b
    c, shape = np.array([r.c for r in top], np.int64), np.array([r["shape"] for r in top], np.int64)
    soft = min(softmax_words, len(top))
    for row, weight in zip(stats, (c, np.ones(len(c)), c == 1, c == 2)):
        row += np.bincount(shape[soft:], weight[soft:], SHAPES)
    total, kinds, ones, twos = stats
    discount = np.clip((ones + 0.5) / (ones + 2 * twos + 1), 0.05, 0.95)
    unseen = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    known = Counts(sum(b.c for b in bands) + seen, sum(b.k for b in bands) + (seen > 0), seen,
                   _hashes([bytes(r.word) for r in top]), c, shape, soft, total, discount, unseen)
    return known, tail.select("word", "c")


def _tokens(w: H.Words, at: np.ndarray, shape: np.ndarray, known: Counts):
    """(ids, first) of a slice: the words of each document and its end; ``at`` is the place in the head, -1 if none."""
    soft = known.softmax
    word = np.where((at >= 0) & (at < soft), at + 1, shape + soft + 1)
    first = np.concatenate([[0], np.cumsum(np.diff(w.first) + 1)])
    ids = np.full(first[-1], END, known.kind)
    ids[np.arange(len(word)) + w.doc] = word
    return ids, first


def _average(batches):
    """Rows (tokens, weights) to their sums, one model in memory at a time."""
    total, tokens = None, 0
    for batch in batches:
        for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("weights")):
            values = np.frombuffer(raw.as_py(), np.float32).astype(np.float64) * n
            total, tokens = values if total is None else total + values, tokens + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["tokens", "weights"])


POOL = 1 << 20


def pooled(batches, kind, most: int, pool: int = POOL):
    """(rows, ids, first) of groups of documents from batches (row, packed token ids).

    A group fills ``most`` streams of near equal length: documents longer than a
    stream of a full group wait for each other, and make groups of their own.
    """
    reuse_memory()
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def group(long):
        parts, held[long], size[long] = held[long], [], 0
        return (np.concatenate([r for r, _, _ in parts]), np.concatenate([x for _, x, _ in parts]),
                np.concatenate([[0], np.cumsum(np.concatenate([n for _, _, n in parts]))]))

    for batch in batches:
        rows = np.asarray(batch.column(0))
        for a, b, body, off in slices(batch.column(1), 1 << 20):
            ids, first = np.frombuffer(body.tobytes(), kind), off // np.dtype(kind).itemsize
            n = np.diff(first)
            for long in (False, True):
                mine = np.flatnonzero((n * most > pool) == long)
                if len(mine):
                    begin = np.cumsum(n[mine]) - n[mine]
                    at = np.repeat(first[mine] - begin, n[mine]) + np.arange(int(n[mine].sum()))
                    held[long].append((rows[a:b][mine], ids[at], n[mine]))
                    size[long] += len(at)
                if size[long] >= pool * (4 if long else 1):
                    yield group(long)
    for long in (False, True):
        if held[long]:
            yield group(long)


def train(parts: DataFrame, known: Counts, size: int = 16, window: int = 16, most: int = 256, rounds: int = 4,
          rate: float = 0.01) -> Network:
    """Network from every window of the token ids of a table (row, id, ids)."""
    net = network(np.concatenate([[known.docs], known.c[:known.softmax]]), known.total, size)
    for k in range(rounds):
        start, step = net, rate * 0.6 ** k

        def run(batches):
            own, tokens = start.filled(start.flat()), 0
            opt = Adam(own, step)
            for _, ids, first in pooled(batches, known.kind, most):
                learn(own, opt, ids, first, window, most)
                tokens += len(ids)
            if tokens:
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task % GROUPS], pa.int32()), pa.array([task], pa.int32()), pa.array([tokens], pa.int64()),
                     pa.array([own.flat().tobytes()], pa.binary())], ["part", "task", "tokens", "weights"])

        part = parts.where(F.pmod(F.hash("id"), F.lit(rounds)) == k).select("row", "ids")
        sums = (part.mapInArrow(run, "part int, task int, tokens long, weights binary")
                .repartition(GROUPS, "part").sortWithinPartitions("task").select("tokens", "weights")
                .mapInArrow(_average, "tokens long, weights binary").collect())  # at most GROUPS models
        if sums:
            total = sum(np.frombuffer(r.weights) for r in sorted(sums, key=lambda r: (r.tokens, bytes(r.weights))))
            net = net.filled(total / sum(r.tokens for r in sums))
    return net


def _parts(known: Counts):
    """Rows (id, held_out, text) to what a task can tell of each document without the network, its token ids, and its
    words beyond the head."""
    soft = known.softmax
    base = np.log10((known.c + 1.0) / known.base)
    end = math.log10((known.docs + 1.0) / known.base)
    share = np.zeros(len(known.c))
    s = known.head_shape[soft:]
    share[soft:] = np.log10((known.c[soft:] - known.discount[s]) / known.total[s])

    def run(batches):
        look, row = Lookup(known.head), TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, body, off in slices(batch.column(2), 1 << 20):
                body = H.lower_ascii(body)
                w = H.split_words(body, off)
                at, n = look(w.hash), b - a
                hit = np.flatnonzero(at >= 0)
                doc, place = w.doc[hit], at[hit]
                far = np.flatnonzero(at < 0)
                kind = np.empty(len(at), np.int16)
                kind[hit], kind[far] = known.head_shape[place], _shaped(body, w, far)[1]
                ids, first = _tokens(w, at, kind, known)
                known_n = np.bincount(doc, minlength=n) + int(known.docs > 0)
                # words beyond the head, once for each document
                order = far[np.argsort(w.hash[far])]
                order = order[np.argsort(w.doc[order].astype(np.min_scalar_type(n)), kind="stable")]
                h, d = w.hash[order], w.doc[order]
                lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[:len(h)])
                times = np.diff(np.append(lead, len(h)))
                pick = order[lead]
                edge = np.searchsorted(d[lead], np.arange(n + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(
                    [word_bytes(body, w.start[pick], w.end[pick]), pa.array(kind[pick].astype(np.int32)), pa.array(times)],
                    ["word", "shape", "n"]))
                width = ids.dtype.itemsize
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(np.diff(first)),
                     pa.array(known_n), pa.array(np.bincount(doc, base[place], n) + end), pa.array(np.bincount(doc, share[place], n) + 0.0),
                     packed, rest],
                    ["row", "id", "held_out", "n_tokens", "n_known", "base", "share", "ids", "rest"])
                row += n

    return run


def _scored(net: Network, kind, window: int, most: int):
    """Rows (row, ids) to (row, log10 probability by the network)."""
    def run(batches):
        for rows, ids, first in pooled(batches, kind, most):
            logp = likelihood(net, ids, first, window, most) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(logp)], ["row", "logp"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", softmax_words: int = 1023, head: int = 1 << 18,
          size: int = 16, window: int = 16, most: int = 256, rounds: int = 4, rate: float = 0.01) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); scores are sums of log10."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known, tail = count(rows.where(~F.col("held_out")), softmax_words, head)
    id_type = dict(rows.dtypes)["id"]
    parts = cut(rows.mapInArrow(_parts(known), f"row long, id {id_type}, held_out boolean, n_tokens long, n_known long, "
                                               "base double, share double, ids binary, rest array<struct<word:binary,shape:int,n:long>>"))
    net = train(parts.where(~F.col("held_out")), known, size, window, most, rounds, rate)
    own = parts.select("row", "ids").mapInArrow(_scored(net, known.kind, window, most), "row long, logp double")
    total, discount, unseen = ([float(x) for x in a] for a in (known.total, known.discount, known.unseen))

    def by_shape(values):
        return F.get(F.array(*map(F.lit, values)), F.col("x.shape"))

    far = parts.select("row", F.explode("rest").alias("x")).withColumn("word", F.col("x.word")).join(tail, "word", "left")
    c, n = F.coalesce(F.col("c"), F.lit(0)), F.col("x.n")
    share = F.when(c > 0, (c - by_shape(discount)) / by_shape(total)).otherwise(by_shape(unseen))
    far = far.select("row", F.when(c > 0, n).otherwise(0).alias("far_known"), (n * F.log10((c + 1.0) / known.base)).alias("far_base"),
                     (n * F.log10(share)).alias("far_share"))
    # every document has a row of its own, so the sums join nothing but rows
    both = (parts.select("row", "id", "held_out", "n_tokens", "n_known", "base", "share").join(own, "row")
            .join(far.groupBy("row").agg(*[F.sum(x).alias(x) for x in far.columns[1:]]), "row", "left"))

    def plus(*names):
        return sum((F.coalesce(F.col(x), F.lit(0)) for x in names[1:]), F.col(names[0]))

    return both.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", plus("n_known", "far_known").alias("n_known"),
                       F.lit(known.n).cast("long").alias("train_tokens"), plus("base", "far_base").alias("base_score"),
                       plus("logp", "share", "far_share").alias("score"))
