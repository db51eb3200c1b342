"""Positions in a global order without a single-partition window.

``row_number() OVER (ORDER BY k)`` with no partition key moves every row to
one task.  ``global_index`` gives the same 0-based position distributed:

1. range-partition and sort by the key (a distributed sort),
2. checkpoint it to the shared folder, which fixes each partition's content
   (so the two passes below see identical partitions, also after an
   executor loss) and cuts the lineage,
3. count rows per partition (one row per partition) and turn the counts into
   offsets (bounded by the partition count),
4. number rows inside each partition in one ``mapInPandas`` pass (order
   preserved, no shuffle) and add the partition's offset (broadcast join on
   a table with one row per partition).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import checkpoint_dir


def global_index(df: DataFrame, order_cols: list, index_col: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Adds ``index_col`` = 0-based position of the row in ``order_cols`` order
    (the order key should be unique for a deterministic result)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or spark.sparkContext.defaultParallelism
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ordered = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).checkpoint(eager=True)
    with_pid = ordered.withColumn("_pid", F.spark_partition_id())
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))

    schema = T.StructType(with_pid.schema.fields + [T.StructField("_local", T.LongType())])

    def number(batches):
        seen = 0
        for pdf in batches:
            pdf = pdf.copy()
            pdf["_local"] = pd.Series(range(seen, seen + len(pdf)), index=pdf.index, dtype="int64")
            seen += len(pdf)
            yield pdf

    local = with_pid.mapInPandas(number, schema)
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_off"))
