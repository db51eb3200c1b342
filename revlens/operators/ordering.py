"""Checked order (O02-O04): a position column in place of an order that readers lose.

Rows are range-partitioned and sorted by the order, written with the number of
their part, and numbered within it; a small table of rows per part gives what
comes before.  No task holds more than its part and nothing goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import written


def with_position(df: DataFrame, order: list, out: str = "position") -> DataFrame:
    """``df`` with ``out``: 1, 2, 3, ... in ``order`` (columns or names, unique together)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per part, so this window is small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (part.withColumn("_row", F.row_number().over(inside)).join(sizes, "_part")
            .withColumn(out, (F.col("_before") + F.col("_row")).cast("long")).drop("_part", "_row", "_before"))
