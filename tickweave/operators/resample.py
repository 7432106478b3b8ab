"""Systematic resampling of a table of weighted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one block of the prefix sum.
BLOCK = 65_536


def systematic_counts(rows: DataFrame, id_col: str, weight: str, draws: int, u: float) -> DataFrame:
    """Add ``copies``: how many of the points (i + u) / draws fall on a row's share of the total weight, in order of id.

    The prefix sum runs within blocks of ids; only the blocks' sums (one row for
    ``BLOCK`` ids) pass through a single task.
    """
    blocked = rows.withColumn("__b", F.floor(F.col(id_col) / BLOCK))
    sums = blocked.groupBy("__b").agg(F.sum(weight).alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("__total"))
    inside = F.sum(weight).over(Window.partitionBy("__b").orderBy(id_col))
    high = F.col("__before") + inside
    point = lambda x: F.least(F.ceil(x / F.col("__total") * draws - u - 1e-9), F.lit(draws))
    out = blocked.join(before, "__b").withColumn("__hi", high)
    return out.withColumn("copies", (point(F.col("__hi")) - point(F.col("__hi") - F.col(weight))).cast("long")).drop("__b", "__before", "__total", "__hi")
