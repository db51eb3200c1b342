import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from revlens.llm import hashing as H
from revlens.llm.components import components
from revlens.llm.hilbert import curve_shards, hilbert_index, write_shards
from revlens.llm.ngram_jaccard import jaccard_join, local_components, overlap_links
from revlens.llm.packing import Encoder, best_cuts, pack
from revlens.llm.relative_lz import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_follow_the_pattern():
    texts = ["a b", "", "  x\ty\n", " a \x1cb\x85", "É é", "one"]
    data = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(d) for d in data])]
    w = H.split_words(np.frombuffer(b"".join(data), np.uint8), off)
    body = b"".join(data)
    got = [[body[w.start[i]:w.end[i]].decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    assert len(set(w.hash.tolist())) == len({x for t in texts for x in WORD.findall(t)})


def test_sliding_min():
    a = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 7, 43):
        assert H.sliding_min(a, width).tolist() == [a[i:i + width].min() for i in range(51 - width)]


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(200, 260)] + [(None, 3), (7, 7), (300, 299), (299, 300)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[230] == 100 and got[300] == 299
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_against_brute_force(corpus, empty):
    rows = [(r.doc_id, _shingles(r.text)) for r in corpus.collect()]
    known = [(i, s) for i, s in rows if i is not None and s]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = sorted((str(i), len(s), None if i is None else root(i)) for i, s in rows)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join(corpus).collect())
    assert got == want
    assert jaccard_join(empty).count() == 0


def test_short_near_copies_are_linked(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(420):  # 30 pairs of each length from 7 to 20 words; words of their own, one or two words more
        w = [f"p{i}x{k}" for k in range(7 + i % 14)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + [f"e{i}", f"f{i}"][:rng.integers(1, 3)]))]
    sets = {i: _shingles(t) for i, t in rows}
    up = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                up[i] = min(up[i], up[j])
    got = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == up and sum(i != k for i, k in up.items()) > 250


def test_sets_of_n_grams_do_not_stay_on_disk(spark, tmp_path, monkeypatch):
    import os
    import uuid

    from revlens.llm import common
    monkeypatch.setattr(common, "scratch", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    # 40 near copies of one text and as many texts of their own
    rows = [(i, " ".join([f"w{k}" for k in range(60)] + [f"x{i}"])) for i in range(40)]
    rows += [(100 + i, " ".join(f"y{i}z{k}" for k in range(9))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = [spark.read.parquet(str(f)) for f in tmp_path.iterdir() if any(x.endswith(".parquet") for x in os.listdir(f))]
    assert got == {i: 0 if i < 40 else i for i, _ in rows}
    assert kept and not [t for t in kept if "grams" in t.columns]


def test_wide_groups_split_into_row_blocks(spark, monkeypatch):
    import revlens.llm.ngram_jaccard as op
    monkeypatch.setattr(op, "ROW_BLOCK", 4)  # read on the driver: groups of more than four documents are split
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):  # a chain of changes: neighbours link, the ends do not
        w = list(base)
        for k in range(i):
            w[k] = f"x{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join(docs).collect()}
    sets = {i: _shingles(t) for i, t in rows}
    up = list(range(30))
    for i in range(30):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[i] = min(up[i], up[j])
    assert got == {i: up[i] for i in range(30)}


def test_overlap_product_and_local_components():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 9], [7], [])]
    m = overlap_links(sets, np.arange(5), np.arange(5), 3, 4)
    assert m[0, 1] and not m[0, 2] and not m[4].any()
    linked = np.zeros((5, 5), bool)
    linked[0, 3] = linked[3, 0] = linked[3, 4] = linked[4, 3] = True
    assert local_components(linked).tolist() == [0, 1, 2, 0, 0]


def test_substring_dedup_against_brute_force(corpus, empty):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in corpus.collect()]
    first = {}
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - 49):
                x = b" ".join(w[k:k + 50])
                first[x] = min(first.get(x, i), i)
    want = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[b" ".join(w[k:k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup(corpus).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(want)
    assert sum(x[2] for x in want) > 200 and substring_dedup(empty).count() == 0


ODD_TEXTS = ["a b c", " lead", "trail ", "two  spaces", "a\nb\n\nc", "x \n y", "tab\tand space", "It's we'll 12.5%",
             "<|endoftext|> in <|endoftext|>", "", "é ü ß 中文 字", "\x1c\x85", "a\rb \r c", "\rfirst", "w\n"]


def test_encoder_equals_the_tokenizer():
    e = Encoder(None)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in e.encode(ODD_TEXTS)] == [t.encode(x, add_special_tokens=False).ids for x in ODD_TEXTS]


def test_encoder_with_a_small_table_and_colliding_words():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = [[" ".join(f"w{rng.randrange(300)}x" for _ in range(rng.randrange(1, 60))) for _ in range(20)] + ODD_TEXTS for _ in range(30)]
    e = Encoder(None, table_bytes=2000)
    for part in texts:
        assert [x.tolist() for x in e.encode(part)] == [t.encode(x, add_special_tokens=False).ids for x in part]
    assert len(e.table.key) < 2000
    e.table.bytes[:] = 0                          # every word now looks like another one with the same hash
    for part in texts:
        assert [x.tolist() for x in e.encode(part)] == [t.encode(x, add_special_tokens=False).ids for x in part]


@pytest.mark.parametrize("stretch", [None, 150, 2000])
def test_pack_is_an_exact_round_trip(corpus, empty, stretch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), tuple(t.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in corpus.collect())
    pieces = (pack(corpus) if stretch is None else pack(corpus, stretch=stretch)).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    left = {}
    for i, ids in want:
        left.setdefault(i, []).append(np.array(ids, np.uint32))
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32
                   for x in left[str(p.doc_id)])
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
    assert pack(empty).count() == 0


def test_best_cuts_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.r_[0, np.cumsum(rng.integers(1, 6, 9))]
        penalty = rng.integers(0, 4, len(at))
        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + 10 - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 10) + penalty[j]
        cuts = best_cuts(at, penalty, 10)
        edges = [0] + cuts
        cost = sum(10 - (b - a) for a, b in zip(edges, cuts)) + sum(penalty[list(at).index(c)] for c in cuts)
        assert cost == best[-1] and cuts[-1] == at[-1] and max(np.diff(edges)) <= 10


def test_hilbert_curve_steps_by_one():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = grid[np.argsort(hilbert_index(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards_hold_equal_counts(corpus, empty, tmp_path):
    got = curve_shards(corpus, ["lang", "source", "n_chars"], shards=7).collect()
    rows = corpus.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(v) for v in by.values()]
    assert max(counts) - min(counts) <= 1 and set(by) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert curve_shards(empty, ["lang", "n_chars"]).count() == 0


def test_steps_spread_few_values_and_tell_long_prefixes_apart(spark):
    from revlens.llm.hilbert import _step, quantile_bounds
    import pandas as pd
    rows = [(["de", "en", "es", "fr"][i % 4], f"https://example.org/a/long/prefix/{i % 40:02}", i, None) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, source string, n long, nothing string").repartition(3)
    lang, source, n, nothing = quantile_bounds(df, ["lang", "source", "n", "nothing"], 5)
    assert _step(pd.Series(["de", "en", "es", "fr", None]), lang).tolist()[:4] == [4, 12, 20, 27]
    names = [f"https://example.org/a/long/prefix/{i:02}" for i in range(40)]
    steps = _step(pd.Series(names), source)
    assert (np.diff(steps) >= 0).all() and steps[0] <= 1 and steps[-1] >= 30 and len(set(steps.tolist())) >= 25
    want = [sorted(r[1] for r in rows)[-(-400 * k // 32) - 1] for k in range(1, 32)]
    assert source.tolist() == want
    assert _step(pd.Series([0, 399]), n).tolist() == [0, 31] and _step(pd.Series([None]), nothing).tolist() == [0]


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 30}" if i < 240 else f"own {i}", ["de", "en", "es", "fr"][i % 4], f"s{i % 7}", i % 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = curve_shards(docs, ["lang", "source", "n_chars"], shards=8).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7 and max(map(len, shards.values())) == 2
    counts = np.bincount([r.shard for r in got])
    assert counts.max() - counts.min() <= 1


def test_shards_are_written_whole(spark, corpus, tmp_path):
    docs = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    write_shards(docs, curve_shards(docs, ["lang", "n_chars"], shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4
