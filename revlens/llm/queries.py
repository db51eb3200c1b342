"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with cosine 0.93 or more within their label."""
    from revlens.llm.pivot_index import near_vectors
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document without the windows of 50 words that smaller ids hold."""
    from revlens.llm.relative_lz import substring_dedup
    return (substring_dedup(_read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have Jaccard similarity 0.75 or more."""
    from revlens.llm.ngram_jaccard import jaccard_join
    return jaccard_join(_read(spark, sf_dir, "documents"))


def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents, learnt from the labels outside the held-out third."""
    from revlens.llm.toxicity import toxicity
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    from revlens.llm.packing import pack
    return pack(_read(spark, sf_dir, "documents"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document along a Hilbert curve over language, source and length."""
    from revlens.llm.hilbert import curve_shards
    return curve_shards(_read(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with the digest of the masked text."""
    from revlens.llm.secret_forest import scan, train
    docs = _read(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def op8_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from revlens.llm.site_tree import extract
    return extract(_read(spark, sf_dir, "pages"))


def op9_latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, by pair."""
    from revlens.llm.latent_search import contamination
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages as read back from the written archives."""
    from revlens.llm.warc import round_trip
    return round_trip(_read(spark, sf_dir, "pages"))


def op11_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document by a gated recurrent network learnt from those not held out."""
    from revlens.llm.gated_lm import score
    return score(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of each document in the Merkle manifest of all documents."""
    from revlens.llm.merkle import verify
    return verify(_read(spark, sf_dir, "documents"))


def op13_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of all documents in a sample drawn towards the benchmark's texts."""
    from revlens.llm.resampling import resample
    return (resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_permutation": sql.OP1, "op2_relative_lz": sql.OP2, "op3_ngram_jaccard": sql.OP3,
            "op10_warc": sql.OP10, "op12_merkle_manifest": sql.OP12, "op13_segment_resampling": sql.OP13}
