"""Corpus pipeline: five stages, each a Spark job over all that the one before kept.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet in the shared folder and read back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import latent_search, ngram_jaccard, packing, secret_forest, toxicity
from revlens.llm.common import cut
from revlens.session import ship_library


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.7."""
    ship_library(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, out=name).where(F.col(name) < 0.7).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (rows without an id all stay)."""
    ship_library(spark)
    groups = ngram_jaccard.jaccard_join(docs).select(
        F.col("doc_id").alias("_id"), F.col("component_id").alias("_group"))
    gone = cut(groups.where("_id <> _group").select("_id").distinct())
    return docs.join(gone, docs.doc_id == gone["_id"], "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_library(spark)
    return latent_search.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew."""
    ship_library(spark)
    out = secret_forest.redact(docs, secret_forest.train(docs))
    if "n_chars" not in docs.columns:
        return out
    kind = dict(docs.dtypes)["n_chars"]
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)
    return out.withColumn("n_chars", n).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of at most 2048 tokens."""
    ship_library(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_benchmark),
          ("secret_scan", mask_secrets), ("packing", pack)]

#: SQL can express neither the trained models nor the tokenizer; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
