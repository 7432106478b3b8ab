"""Per-row and windowed features of ordered series.

Every function takes the key column(s) and the order columns of a series and adds
columns; a series is never collected, all frames are windows with one shuffle by
the key that consecutive features share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log-square of returns too small to take the logarithm of.
LOG_SQUARE_FLOOR, TINY = -23.0, 1e-10
TRADING_DAYS = 252


def by(key: str | Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def log_returns(frame: DataFrame, key, order, price: str, out: str) -> DataFrame:
    """Null at the first price of a series and where this or the last price isn't positive."""
    last = F.lag(price).over(by(key, order))
    return frame.withColumn(out, F.when((F.col(price) > 0) & (last > 0), F.log(F.col(price) / last)))


def simple_returns(frame: DataFrame, key, order, price: str, out: str) -> DataFrame:
    """Null at the first price of a series and after a price of zero."""
    return frame.withColumn(out, F.try_divide(F.col(price), F.lag(price).over(by(key, order))) - 1)


def log_square(ret: Column) -> Column:
    """ln(ret^2), with a floor for vanishing returns."""
    return F.when(F.abs(ret) < TINY, F.lit(LOG_SQUARE_FLOOR)).otherwise(F.log(ret * ret))


def zero_clamp(ret: Column, floor: float) -> Column:
    """Returns smaller than ``floor`` become the floor with their sign."""
    return F.when(F.abs(ret) < floor, F.when(ret < 0, -floor).otherwise(floor)).otherwise(ret)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def rolling_std(frame: DataFrame, key, order, value: str, rows: int, out: str, annualise: bool = False) -> DataFrame:
    """Sample deviation of the last ``rows`` values; null until there are so many."""
    frame_of = by(key, order).rowsBetween(-(rows - 1), 0)
    std = F.stddev_samp(value).over(frame_of) * (TRADING_DAYS**0.5 if annualise else 1.0)
    return frame.withColumn(out, F.when(F.count(value).over(frame_of) == rows, std))


def centred_mean(frame: DataFrame, key, order, value: str, each_side: int, out: str) -> DataFrame:
    """Mean of the neighbours on each side, cut off at the ends."""
    return frame.withColumn(out, F.avg(value).over(by(key, order).rowsBetween(-each_side, each_side)))


def cumulative_return(frame: DataFrame, key, order, ret: str, out: str) -> DataFrame:
    """Compound return so far."""
    return frame.withColumn(out, F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(by(key, order).rowsBetween(Window.unboundedPreceding, 0))) - 1)


def winsorize(frame: DataFrame, key, value: str, deviations: float, out: str) -> DataFrame:
    """Values clipped to mean +- deviations (population) of their key; aggregated before the join."""
    keys = [key] if isinstance(key, str) else list(key)
    bounds = frame.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    low, high = F.col("__m") - deviations * F.col("__s"), F.col("__m") + deviations * F.col("__s")
    return frame.join(bounds, keys).withColumn(out, F.greatest(F.least(F.col(value), high), low)).drop("__m", "__s")


def outlier_flags(frame: DataFrame, key, value: str, deviations: float, out: str) -> DataFrame:
    """Whether a value lies more than so many (population) deviations from its key's mean."""
    keys = [key] if isinstance(key, str) else list(key)
    bounds = frame.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return frame.join(bounds, keys).withColumn(out, F.abs(F.col(value) - F.col("__m")) > deviations * F.col("__s")).drop("__m", "__s")


def runs(frame: DataFrame, key, order, state: str) -> DataFrame:
    """Add run_id (from 0), run_age (ticks in the run, from 1) and switched (first tick of a later run)."""
    w = by(key, order)
    switched = F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(False))
    out = frame.withColumn("switched", switched).withColumn("run_id", F.sum(F.col("switched").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [key] if isinstance(key, str) else list(key)
    return out.withColumn("run_age", F.row_number().over(by([*keys, "run_id"], order)))


def fixed_lag(frame: DataFrame, key, order, value: str, lag: int, out: str) -> DataFrame:
    """The value of ``lag - 1`` ticks ago, or the current one until there are so many; ``<out>_valid`` tells which."""
    old = F.lag(value, lag - 1).over(by(key, order))
    ready = F.row_number().over(by(key, order)) >= lag
    return frame.withColumn(out, F.when(ready, old).otherwise(F.col(value))).withColumn(f"{out}_valid", ready)


def minute_bin(ts: Column, open_minute: int, close_minute: int, bins: int) -> Column:
    """Session time as a bin; times outside the session count as its ends."""
    minute = F.greatest(F.least(F.hour(ts) * 60 + F.minute(ts), F.lit(close_minute - 1)), F.lit(open_minute)) - open_minute
    return F.floor(minute * bins / F.lit(close_minute - open_minute)).cast("int")


def diurnal_profile(frame: DataFrame, bin_col: str, ret: str, bins: int, least: int = 10, low: float = 0.3, high: float = 3.0, smooth: int = 3) -> DataFrame:
    """bin, factor: root mean square of a bin over that of all, smoothed over neighbours; bins with few ticks count as 1.

    Every bin has a row; the table has ``bins`` rows, whatever the input's size.
    """
    spark = frame.sparkSession
    squares = F.col(ret) * F.col(ret)
    each = frame.where(F.col(ret).isNotNull()).groupBy(F.col(bin_col).alias("bin")).agg(F.sum(squares).alias("s"), F.count(F.lit(1)).alias("n"))
    each = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(each), "bin", "left")
    total = each.agg(F.sqrt(F.sum("s") / F.sum("n")).alias("total"))
    raw = F.when(F.coalesce("n", F.lit(0)) < least, F.lit(1.0)).otherwise(F.try_divide(F.sqrt(F.col("s") / F.col("n")), F.col("total")))
    rows = each.crossJoin(F.broadcast(total)).select("bin", F.greatest(F.least(raw, F.lit(high)), F.lit(low)).alias("raw"), F.lit(0).alias("one"))
    return centred_mean(rows, "one", ["bin"], "raw", smooth, "factor").select("bin", "factor")


def ushape(spark, bins: int) -> DataFrame:
    """bin, factor: parametric U shape over the session, with mean 1."""
    t = F.col("bin") / F.lit(float(bins - 1))
    shape = 0.8 + 0.6 * F.exp(-50 * t * t) + 0.5 * F.exp(-50 * (1 - t) * (1 - t)) - 0.3 * F.exp(-20 * (t - 0.5) * (t - 0.5))
    rows = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("shape", shape)
    return rows.crossJoin(rows.agg(F.avg("shape").alias("mean"))).select("bin", (F.col("shape") / F.col("mean")).alias("factor"))
