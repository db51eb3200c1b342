"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from revlens.llm import gated_lm as G
from revlens.llm import merkle, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    return [tuple(r) for r in rows]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


# 12

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=3):
    """rows: (doc_id, text, lang, source, n_chars); results by row number."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, t, lang, s, n):
        return H(*map(field, (i, s, lang, n, t)))

    def tampered(i, t):
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        return t.replace("\n", "") if even and t is not None else t

    def climb(level):
        """(root, list of proofs) of a list of digests."""
        proofs, place = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, p in enumerate(place):
                run = p // arity * arity
                proofs[k].append((level[run:p], level[p + 1:run + arity]))
            level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
            place = [p // arity for p in place]
        return level[0], proofs

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[3], []).append(k)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, low = [], {}
    for s in names:
        info = sorted((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], tampered(r[0], r[1]), *r[2:]), k)
                      for k, r in ((k, rows[k]) for k in groups[s]))
        root, proofs = climb([x[2] for x in info])
        subroots.append(root)
        for x, p in zip(info, proofs):
            low[x[4]] = (x[2], x[3], root, p)
    root, high = climb(subroots)
    out = []
    for k, r in enumerate(rows):
        own, check, sub, proof = low[k]
        proof = proof + high[names.index(r[3])]
        folded = check
        for a, b in proof:
            folded = H(*a, folded, *b)
        out.append((r[0], own, sub, root, H(*[x for a, b in proof for x in a + b]), folded, folded == root))
    return out


@pytest.mark.parametrize("levels", [2, 5])
def test_manifest_matches_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = []
    for i in range(130):
        source = rng.choice(["a", "b", "hot", "hot", "hot", "hot", "", None, "é", "z\n"])
        rows.append((i if i % 29 else None, rng.choice([None, "", "x", "one\ntwo", "\n\n", "é\n" * 40]), rng.choice(["en", None]),
                     source, rng.choice([None, 0, 5])))
    rows += [(7, "again", "en", "hot", 5), (7, "again", "en", "hot", 5), (7, "other\n", "en", "hot", 5), (-5, "neg\n", "x", "alone", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as h", "1 as pos", "'x' as key").repartition(5)
    want = brute_manifest(rows)
    # rows that share all of their fields may swap their places, and so their proofs
    assert same(plain(merkle.verify(docs, levels=levels).collect()), want)
    assert any(w[6] for w in want) and not all(w[6] for w in want)


def test_manifest_of_small_groups(spark):
    rows = [(100 * n + i, f"t{i}\n", "en", f"s{n:02}", i) for n in (1, 2, 3, 4, 9, 10) for i in range(n)]
    assert same(plain(merkle.verify(spark.createDataFrame(rows, DOCS), levels=1).collect()), brute_manifest(rows))


def test_manifest_of_an_empty_table_and_long_texts(spark, empty):
    assert merkle.verify(empty).collect() == []
    rows = [(1, "a\n" * 300_000, None, None, None), (2, None, None, None, None)]
    assert same(plain(merkle.verify(spark.createDataFrame(rows, DOCS)).collect()), brute_manifest(rows))


# 13

def brute_resample(rows, target, n=1, buckets=10000, percent=10, least=20, seed=2024):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        runs = [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    usable = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[4], o[0]))
    for k, o in enumerate(usable[:len(usable) * percent // 100]):
        o[5] = k + 1
    return [tuple(o) for o in out]


def corpus_rows(seed=5):
    rng = random.Random(seed)
    vocab = [f"Word{i}" for i in range(200)] + ["the", "of", "é", "3rd"] * 20
    common = [" ".join(rng.choices(vocab, k=9)) for _ in range(6)]
    rows = []
    for i in range(90):
        lines = [rng.choice(common) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randrange(0, 12))) for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "... !\n--"), (94, "A\tb c\x7fd\n  E-f_g"), (95, " ".join(rng.choices(vocab, k=5000)))]
    return rows, [common[0], common[1] + " Word5", None, "Word7\nWord8"]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_matches_brute_force(spark, n):
    rows, target = corpus_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as weight", "2 as n").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    options = dict(n=n, buckets=300, percent=30, least_words=10)
    got = plain(resampling.resample(docs, wanted, **options).collect())
    assert same(got, brute_resample(rows, target, n, 300, 30, 10))


def test_resampling_of_repeated_ids_nulls_and_empty_tables(spark, empty):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a a a"), (2, "d e f"), (2, None)]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    got = plain(resampling.resample(docs, wanted, percent=50, least_words=3, buckets=50).collect())
    want = brute_resample([r for r in rows if r[0] is not None], ["a"], buckets=50)
    assert len(got) == 5 and sorted(r[5] for r in got if r[5]) == [1, 2]
    assert {g[0] for g in got} == {1, 2, None} and len(want) == 4
    assert resampling.resample(empty, wanted).collect() == []
    nothing = wanted.where("false")
    got = plain(resampling.resample(docs.where("doc_id = 2"), nothing, percent=100, least_words=0, buckets=50).collect())
    assert same(got, brute_resample([r for r in rows if r[0] == 2], [], buckets=50, percent=100, least=0))


# 11

def small_network(kind=np.float64):
    rng = np.random.default_rng(1)
    return G.network(rng.integers(1, 50, 150).astype(float), rng.integers(0, 20, G.SHAPES).astype(float), 5, kind=kind)


def random_docs(rng, n, top):
    docs = [rng.integers(0, top, k).astype(np.int16) for k in rng.integers(1, 40, n)]
    return docs, np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def plain_likelihood(net, doc):
    """One document, token by token."""
    w, n = net.w, net.w["u"].shape[0]
    h, before, total = np.zeros(n), G.END, 0.0
    for t in doc.tolist():
        x, g = w["in"][before], h @ w["u"]
        z, r = (1 / (1 + np.exp(-(x[k * n:k * n + n] + g[k * n:k * n + n]))) for k in (0, 1))
        new = np.tanh(x[2 * n:] + r * g[2 * n:])
        h = (1 - z) * new + z * h
        logits = h @ w["c"][:-1] + w["c"][-1]
        c = int(net.class_of(np.array([t]))[0])
        total += logits[c] - np.log(np.exp(logits).sum())
        if t < net.n_words:
            a, b = c * G.CLASS, min((c + 1) * G.CLASS, net.n_words)
            logits = w["o"][a:b, :-1] @ h + w["o"][a:b, -1]
            total += logits[t - a] - np.log(np.exp(logits).sum())
        before = t
    return total


@pytest.mark.parametrize("window,most", [(1, 1), (4, 3), (64, 100)])
def test_state_is_carried_through_whole_documents(window, most):
    net = small_network()
    docs, ids, first = random_docs(np.random.default_rng(2), 23, net.n_words + G.SHAPES)
    got = G.likelihood(net, ids, first, window, most)
    assert np.allclose(got, [plain_likelihood(net, d) for d in docs])


def test_probabilities_of_the_next_token_sum_to_one():
    net = small_network()
    n = net.n_words + G.SHAPES
    states = np.random.default_rng(3).normal(0, 1, (1, 5)).repeat(n, axis=0)
    logp, _ = G.outputs(net, states, np.arange(n))
    assert math.isclose(np.exp(logp).sum(), 1)


def test_derivatives_match_differences():
    net = small_network()
    _, ids, first = random_docs(np.random.default_rng(4), 9, net.n_words + G.SHAPES)
    s = G.lay_out(ids, first, 4)

    def loss():
        return -G.likelihood(net, ids, first, 1000, 4).sum()

    grads = {k: np.zeros_like(a) for k, a in net.w.items()}
    for index, active in G.steps(s, 1000):
        states, saved = G.forward(net, s, index, active, np.zeros((len(s.length), 5)))
        _, back = G.outputs(net, states, s.ids[index], grads)
        G.backward(net, s, index, saved, back, grads)
    rng = np.random.default_rng(5)
    for k, a in net.w.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-5
            up = loss()
            a[at] = old - 1e-5
            down = loss()
            a[at] = old
            assert math.isclose((up - down) / 2e-5, grads[k][at], rel_tol=1e-4, abs_tol=1e-5), k


def test_windows_are_ranges_of_the_tokens():
    docs, ids, first = random_docs(np.random.default_rng(7), 31, 150)
    s = G.lay_out(ids, first, 6)
    state, got, at = np.full(6, -1), {}, 0
    for index, active in G.steps(s, 5):
        window = s.ids[index]
        assert np.shares_memory(window, s.ids)  # no copy by an index of single tokens
        assert len(window) == active.sum()
        for n in active.tolist():
            for j in range(n):
                d = int(s.doc[at + j])
                assert s.start[at + j] == (d not in got) and (d in got) == (state[j] == d)
                assert s.before[at + j] == (got[d][-1] if d in got else G.END)
                got.setdefault(d, []).append(int(s.ids[at + j]))
                state[j] = d
            at += n
    assert [got[d] for d in range(len(docs))] == [d.tolist() for d in docs]


def test_scoring_takes_more_steps_where_few_streams_are_left(monkeypatch):
    net = small_network()
    rng = np.random.default_rng(10)
    docs = [rng.integers(0, net.n_words + G.SHAPES, n).astype(np.int16) for n in [900, 1000, 1100] + [20] * 40]
    ids, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    plain, sizes = G.outputs, []

    def counted(net, states, ids, *rest):
        sizes.append(len(ids))
        return plain(net, states, ids, *rest)

    monkeypatch.setattr(G, "outputs", counted)
    got = G.likelihood(net, ids, first, 16, 20)
    assert np.allclose(got, [plain_likelihood(net, d) for d in docs])
    assert max(sizes) <= 16 * 20 and sum(sizes) == len(ids)
    assert len(sizes) <= 2 * len(ids) / (16 * 20)  # not one for each 16 of 1100 steps


def test_classes_of_one_width_are_one_softmax(monkeypatch):
    net = small_network()  # classes of 64, 64 and 22 words
    rng = np.random.default_rng(11)
    ids = rng.integers(0, net.n_words, 500)
    states = rng.normal(0, 1, (500, 5))
    plain, rows = np.log, []
    monkeypatch.setattr(np, "log", lambda x, **given: rows.append(len(x)) or plain(x, **given))
    logp, _ = G.outputs(net, states, ids)
    monkeypatch.undo()
    assert rows == [500, int((ids < 128).sum()), int((ids >= 128).sum())]
    hs = np.column_stack([states, np.ones(500)])
    for k in range(3):
        own = np.flatnonzero(ids // 64 == k)
        a, b = hs[own] @ net.w["c"], hs[own] @ net.w["o"][64 * k:64 * k + 64].T
        want = a[:, k] - np.log(np.exp(a).sum(axis=1)) + b[np.arange(len(own)), ids[own] % 64] - np.log(np.exp(b).sum(axis=1))
        assert np.allclose(logp[own], want)


def test_a_step_over_all_weights_is_that_of_each_array():
    net, plain = small_network(), small_network()
    opt = G.Adam(net, 0.01)
    rng = np.random.default_rng(8)
    m, v = ({k: np.zeros_like(a) for k, a in plain.w.items()} for _ in range(2))
    for t in range(1, 4):
        for k, g in net.parts(opt.grads).items():
            given = rng.normal(0, 3, g.shape)
            g += given
            given = np.clip(given / 20, -0.1, 0.1)
            m[k] = m[k] + (given - m[k]) * 0.1
            v[k] = v[k] + (given ** 2 - v[k]) * 0.001
            plain.w[k] -= 0.01 * math.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m[k] / (np.sqrt(v[k]) + 1e-8)
        opt.step(20)
        assert not opt.grads.any()
    assert all(np.allclose(net.w[k], np.clip(a, -20, 20)) for k, a in plain.w.items())


def test_lookup_with_shared_slots():
    keys = np.random.default_rng(6).integers(0, 1 << 20, 500).astype(np.uint64)  # all in the first slots
    keys = np.unique(keys)
    np.random.default_rng(7).shuffle(keys)
    asked = np.concatenate([keys, keys + np.uint64(1 << 40)])
    assert G.Lookup(keys)(asked).tolist() == list(range(len(keys))) + [-1] * len(keys)
    assert G.Lookup(keys[:0])(asked[:3]).tolist() == [-1] * 3


def test_lookup_searches_only_shared_slots(monkeypatch):
    rng = np.random.default_rng(12)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(4))
    look = G.Lookup(keys)
    asked = np.concatenate([keys + np.uint64(1), keys])  # absent ones lie in slots that are not empty
    absent = rng.integers(0, 1 << 62, 20000).astype(np.uint64) * np.uint64(4) + np.uint64(1)
    plain, searched = np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: searched.append(len(v)) or plain(a, v, *rest))
    got = look(asked).tolist()
    assert got == [-1] * len(keys) + list(range(len(keys)))
    searched.clear()
    assert (look(absent) == -1).all()
    assert sum(searched) < len(absent) / 5


def test_pooled_groups_hold_every_document_once():
    import pyarrow as pa
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 99, n).astype(np.int16) for n in [1, 5, 900, 3, 40, 1200, 2, 7, 33, 800, 1]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, min(a + 3, 11)), pa.int64()), pa.array([d.tobytes() for d in docs[a:a + 3]], pa.binary())], ["row", "ids"])
               for a in range(0, 11, 3)]
    got = {}
    for rows, ids, first in G.pooled(batches, np.int16, 4, 200):
        assert len({n > 50 for n in np.diff(first)}) == 1
        got.update({int(r): ids[a:b].tolist() for r, a, b in zip(rows, first, first[1:])})
    assert got == {i: d.tolist() for i, d in enumerate(docs)}


def lm_rows(n=400, seed=9):
    """Texts with an order to learn: a word's successor is nearly fixed."""
    rng = random.Random(seed)
    follow = {i: [(i * 7 + 3) % 60, (i * 11 + 5) % 60] for i in range(60)}
    rows = []
    for i in range(n + 1):
        w, out = rng.randrange(60), []
        for _ in range(rng.randrange(5, 60) if i < n else 12000):
            out.append(f"W{w}" if rng.random() < 0.97 else f"rare{rng.randrange(3000)}x")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(out)))
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "W1 été w1\x85x"), (None, "W1 W2"), (3, "W9 unseen-word 12.5")]


def test_scores_against_brute_force_counts_and_learning(spark):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as score", "2 as held_out").repartition(3)

    def tokens(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words] + [""]

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    c = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    total, kinds = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, out(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), total,
                   round(sum(math.log10((c[t] + 1) / (total + kinds + 1)) for t in tokens(x)), 5)) for i, x in rows)
    # a small head, so that most words meet their counts in the join
    got = G.score(docs, softmax_words=40, head=90, most=8, rate=0.03).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    kept = [r for r in got if r.held_out]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in kept) > 0.9 * sum(r.base_score for r in kept)  # nearer to 0
    # order matters: the same words shuffled are less likely
    rng = random.Random(1)
    mixed = [(i, " ".join(rng.sample((t or "").split(), len((t or "").split()))) if out(i) else t) for i, t in rows]
    options = dict(softmax_words=63, head=90, most=8, rate=0.03)
    in_order, shuffled = (sum(r.score for r in G.score(spark.createDataFrame(x, "doc_id long, text string"), **options).collect() if r.held_out)
                          for x in (rows, mixed))
    assert in_order > 0.95 * shuffled


def test_scores_of_tables_without_training_rows(spark, empty):
    assert G.score(empty).collect() == []
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = G.score(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(3, 0, 0, 0.0)}
    assert all(r.held_out and r.score < 0 for r in got)


def test_windows_of_a_group_use_the_same_memory_again():
    code = """
import resource
import numpy as np, pyarrow as pa
from revlens.llm import gated_lm as G
ids = (np.arange(256 * 160) * 7919 % 1000).astype(np.int16)
rows = pa.array([ids[i:i + 160].tobytes() for i in range(0, len(ids), 160)], pa.binary())
net = G.network(np.ones(1024), np.ones(G.SHAPES))
for _, ids, first in G.pooled([pa.RecordBatch.from_arrays([pa.array(range(256)), rows], ["row", "ids"])], np.int16, 256):
    G.likelihood(net, ids, first, 16, 256)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(5):
        G.likelihood(net, ids, first, 16, 256)
    print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 50)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert float(out.stdout) < 50  # pages a window
