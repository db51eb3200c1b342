"""Positions in a sorted order, per group, without a window over a whole group.

Rows are range-partitioned and sorted by (group, order); the written table keeps
the number of each row's part.  A group's rows lie in consecutive parts, so a
position is the row's number within (part, group) plus the group's rows in the
parts before, which a small table of (part, group, rows) gives.  A group that
holds a third of all rows is spread over a third of the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import cut


def positions(rows: DataFrame, group: list[str], order: list, out: str = "pos") -> DataFrame:
    """``rows`` with ``out``: 0, 1, 2, ... within each group, in ``order`` (columns or names).

    ``group`` columns hold no nulls; full ties of group and order may stand in any
    order.  Without group columns all rows are one group.  An empty table gives
    an empty result.
    """
    keys = [F.col(g) for g in group]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = cut(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = part.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    return (part.withColumn("_row", F.row_number().over(inside) - 1).join(counts, ["_part", *group])
            .withColumn(out, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before"))
