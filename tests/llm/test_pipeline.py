import corpus_pipeline as cp
import pytest
from revlens.llm import latent_search, queries, secret_forest, toxicity
from revlens.llm.ngram_jaccard import jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept, now = {}, docs
    for name, stage in cp.STAGES:
        after = cp.cut(stage(spark, now, SF))
        if name != "packing":
            assert after.columns == columns
        kept[name] = (now, after)
        now = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = kept["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
    ids = {r.doc_id for r in before.collect()}
    assert bad and {r.doc_id for r in after.collect()} == ids - bad
    before, after = kept["ngram_jaccard"]
    first = {r.component_id for r in jaccard_join(before).collect()}
    assert {r.doc_id for r in after.collect()} == first
    before, after = kept["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in latent_search.contamination(before, bench).collect()}
    texts = {r.doc_id: " " + " ".join((r.text or "").split()) + " " for r in before.collect()}
    planted = {i for i, t in texts.items() for b in bench.collect() if " " + " ".join(b.text.split()) + " " in t}
    assert planted <= leaks and {r.doc_id for r in after.collect()} == set(texts) - leaks
    before, after = kept["secret_scan"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text)
        assert not [1 for a, b in secret_forest.candidates(r.text) if secret_forest._FORMAT.fullmatch(r.text[a:b])]
        assert r.text == old[r.doc_id] or secret_forest.MASK in r.text
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_is_the_chain_of_stages(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_every_operator_has_one_query():
    names = sorted(int(k[2:].split("_")[0]) for k in queries.queries())
    assert names == list(range(1, 14))


def test_stages_take_odd_rows(spark, corpus, tmp_path):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a benchmark item of words")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for rows in (corpus, corpus.where("false")):
        now = rows
        for name, stage in cp.STAGES:
            now = cp.cut(stage(spark, now, str(tmp_path)))
        if rows is corpus:
            assert now.count() > 0
