"""Duration of regimes: hazard, survival and expected remaining time by regime and age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duration_table(runs: DataFrame, state: str, length: str, closed: str) -> DataFrame:
    """state, age, at_risk, hazard, survival, remaining from finished and unfinished runs.

    A row for every length that occurs, so the table has at most states x lengths rows.
    Unfinished runs are at risk but don't end.
    """
    age = F.col(length).alias("age")
    ends = runs.groupBy(F.col(state).alias("state"), age).agg(F.sum(F.col(closed).cast("int")).alias("ended"), F.count(F.lit(1)).alias("gone"))
    older = Window.partitionBy("state").orderBy(F.col("age").desc()).rowsBetween(Window.unboundedPreceding, 0)
    younger = Window.partitionBy("state").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    rows = ends.withColumn("at_risk", F.sum("gone").over(older)).withColumn("hazard", F.col("ended") / F.col("at_risk"))
    alive = F.when(F.col("hazard") < 1, F.log(1 - F.col("hazard"))).otherwise(F.lit(-1e3))
    rows = rows.withColumn("survival", F.exp(F.sum(alive).over(younger)))
    later = Window.partitionBy("state").orderBy("age").rowsBetween(0, Window.unboundedFollowing)
    mean_left = F.sum(F.col("gone") * F.col("age")).over(later) / F.col("at_risk") - F.col("age")
    return rows.select("state", "age", "at_risk", "hazard", "survival", mean_left.alias("remaining"))


def with_duration(frame: DataFrame, table: DataFrame, state: str, age: str) -> DataFrame:
    """Ticks with hazard, survival and expected remaining time of their regime at their age, a row per row.

    Ages at which no run has ended take the next longer one that the table has: the table
    is spread over the ages in between, in ranges, and joined by equality.
    """
    before = F.coalesce(F.lag("age").over(Window.partitionBy("state").orderBy("age")), F.lit(0))
    spans = table.select("state", (before + 1).alias("from"), "age", "hazard", "survival", "remaining")
    wide = spans.select(F.col("state").alias("__state"), F.explode(F.sequence("from", "age")).alias("__age"), "hazard", "survival", "remaining")
    rows = frame.join(wide, (F.col(state) == F.col("__state")) & (F.col(age) == F.col("__age")), "left")
    return rows.drop("__state", "__age")


def regime_statistics(frame: DataFrame, key, order, state: str, level: str, speed: float) -> DataFrame:
    """Sufficient statistics of a regime-switching autoregression: n, sums of levels and of innovations, cross moments."""
    from tickweave.operators.features import by

    rows = frame.withColumn("__last", F.lag(level).over(by(key, order))).where("__last is not null")
    e = F.col(level) - (1 - speed) * F.col("__last")
    return rows.groupBy(state).agg(
        F.count(F.lit(1)).alias("n"), F.sum(level).alias("s"), F.sum(F.col(level) ** 2).alias("ss"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"), F.sum(F.col(level) * F.col("__last")).alias("cross"),
    )
