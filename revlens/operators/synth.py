"""Synthetic review table at any size.

The demo seeder's distribution, generated from template rows of the test
tables rather than fixed texts: severity 10/20/70 % (critical and warning
templates drawn without replacement, suggestions with replacement),
70/30 % accepted, repositories assigned round-robin in a shuffled order,
timestamps spread over 30 days and handed out in chronological order.

All randomness is ``md5(seed:tag:key)``, so the table is reproducible and
any task can recompute its rows after an executor loss.  Positions come
from ``global_index`` (distributed), never from a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.sequence import global_index

SPREAD_SECONDS = 30 * 24 * 3600


def _h(seed: str, tag: str, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), key.cast("string")))


def _hint(seed: str, tag: str, key: Column) -> Column:
    """A non-negative 48-bit integer from the hash."""
    return F.conv(F.substring(_h(seed, tag, key), 1, 12), 16, 10).cast("long")


def quota_sample(pool: DataFrame, k: int, seed: str, tag: str, id_col: str) -> DataFrame:
    """K rows without replacement (the k smallest hashes of the id)."""
    ranked = global_index(pool.withColumn("_o", _h(seed, tag, F.col(id_col))), ["_o", id_col], "_r")
    return ranked.filter(F.col("_r") < k).drop("_o", "_r")


def with_replacement(pool: DataFrame, k: int, seed: str, tag: str, id_col: str) -> DataFrame:
    """k draws with replacement: draw j takes pool row hash(j) mod |pool|."""
    spark = pool.sparkSession
    indexed = global_index(pool, [id_col], "_pidx")
    m = indexed.count()
    draws = spark.range(k).withColumnRenamed("id", "_draw").withColumn(
        "_pidx", F.pmod(_hint(seed, tag, F.col("_draw")), F.lit(m)))
    return draws.join(indexed, "_pidx").drop("_pidx")


def permutation(spark, n: int, seed: str, tag: str, name: str) -> DataFrame:
    """(i, name): a seeded permutation of 0..n-1."""
    base = spark.range(n).withColumn("_o", _h(seed, tag, F.col("id")))
    return global_index(base, ["_o", "id"], name).select(F.col("id").alias("i"), name)


def synthetic_reviews(templates: DataFrame, repos: DataFrame, n_total: int, base_ts,
                      seed: str = "revlens") -> DataFrame:
    """``n_total`` review rows.

    ``templates``: (finding_id, severity, category, issue, suggestion) with
    severities critical / high / other; ``repos``: one column ``repo``.
    """
    spark = templates.sparkSession
    k_c, k_w = n_total // 10, n_total // 5
    k_s = n_total - k_c - k_w
    cols = ["finding_id", "category", "issue", "suggestion"]
    crit = (quota_sample(templates.filter(F.col("severity") == "critical"), k_c, seed, "c", "finding_id")
            .select(*cols, F.lit("CRITICAL").alias("severity"),
                    F.concat(F.lit("c"), F.col("finding_id").cast("string")).alias("pick_key")))
    warn = (quota_sample(templates.filter(F.col("severity") == "high"), k_w, seed, "w", "finding_id")
            .select(*cols, F.lit("WARNING").alias("severity"),
                    F.concat(F.lit("w"), F.col("finding_id").cast("string")).alias("pick_key")))
    sugg = (with_replacement(templates.filter(~F.col("severity").isin("critical", "high")), k_s, seed, "s",
                             "finding_id")
            .select(*cols, F.lit("SUGGESTION").alias("severity"),
                    F.concat(F.lit("s"), F.col("_draw").cast("string")).alias("pick_key")))
    picks = crit.unionByName(warn).unionByName(sugg)                                   # U01
    ordered = global_index(picks.withColumn("_o", _h(seed, "order", F.col("pick_key"))), ["_o"], "i").drop("_o")

    n_acc = n_total * 7 // 10
    accepted = permutation(spark, n_total, seed, "a", "_ar").select(
        "i", (F.col("_ar") < n_acc).cast("int").alias("accepted"))
    secs = F.pmod(_hint(seed, "t", F.col("id")), F.lit(SPREAD_SECONDS))
    stamps = spark.range(n_total).withColumn(
        "ts", F.lit(base_ts).cast("timestamp_ntz") - F.make_interval(secs=secs.cast("int")))       # X32
    stamps = global_index(stamps, ["ts", "id"], "i").select("i", "ts")                 # W06: chronological
    repo_list = global_index(repos.select("repo").distinct(), ["repo"], "_ridx")
    m = repo_list.count()
    repo_of = (permutation(spark, n_total, seed, "r", "_rr")
               .withColumn("_ridx", F.pmod(F.col("_rr"), F.lit(m)))                    # W05: round robin
               .join(repo_list, "_ridx").select("i", "repo"))
    return (ordered.join(accepted, "i").join(stamps, "i").join(repo_of, "i")            # J11: pair by position
            .select("i", "pick_key", "finding_id", "severity", "category", F.col("issue").alias("comment"),
                    F.col("suggestion").alias("code_snippet"), "repo", "accepted", "ts"))
