"""Synthetic series from counters: the same numbers in every engine and partitioning."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.fold import ordered_fold

#: scenario, first and last tick, level of log-volatility at both ends, regime.
SCENARIOS = (
    ("calm", 0, 999, -5.0, -5.0, 0), ("trend", 1000, 1999, -4.8, -4.3, 1), ("sudden_crisis", 2000, 2599, -3.4, -3.4, 3), ("persistence", 2600, 3799, -3.6, -3.8, 3),
    ("recovery", 3800, 4999, -3.8, -4.8, 2), ("flash_crash", 5000, 5199, -4.6, -4.6, 1), ("flash_crash", 5200, 5259, -3.0, -3.2, 3), ("flash_crash", 5260, 5499, -4.6, -4.6, 1), ("choppy", 5500, 7499, -4.4, -4.4, 1),
)
#: tick -> size of the outlier in deviations.
OUTLIERS = {300: 6.0, 700: 8.0, 2050: 8.0, 2150: 10.0, 2250: 12.0, 2350: 9.0, 2450: 11.0, 2800: 10.0, 3100: 15.0, 3500: 12.0}


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the MD5 digest of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


UNIFORM_SQL = "SELECT id, ('0x' || substr(md5('tape:' || id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(2000)) AS id)"


def normal(*parts: Column) -> Column:
    """Standard normal by the polar form of two uniform numbers."""
    a, b = uniform(F.lit("n1"), *parts), uniform(F.lit("n2"), *parts)
    return F.sqrt(-2 * F.log(a + F.lit(2.0**-33))) * F.cos(F.lit(2 * math.pi) * b)


class _Ar:
    """Log-volatility that reverts to a given level."""

    OUTPUTS = "true_log_vol double"

    def __init__(self, speed: float = 0.05, sigma: float = 0.08):
        self.speed, self.sigma, self.h = speed, sigma, None

    def step(self, level, eps):
        self.h = level if self.h is None else (1 - self.speed) * self.h + self.speed * level + self.sigma * eps
        return (self.h,)


def scenario_tape(spark: SparkSession, copies: int = 1, seed: int = 1) -> DataFrame:
    """series_id, tick, scenario, true_log_vol, true_regime, ret, is_outlier of ``copies`` independent tapes of 7500 ticks."""
    rows = spark.range(copies * 7500).select((F.col("id") / 7500).cast("long").alias("series_id"), (F.col("id") % 7500).cast("int").alias("tick"))
    scenario, level, regime, size = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(0.0)
    for name, a, b, h0, h1, r in SCENARIOS:
        here = F.col("tick").between(a, b)
        scenario = F.when(here, name).otherwise(scenario)
        level = F.when(here, h0 + (h1 - h0) * (F.col("tick") - a) / F.lit(float(b - a))).otherwise(level)
        regime = F.when(here, r).otherwise(regime)
    for tick, deviations in OUTLIERS.items():
        size = F.when(F.col("tick") == tick, deviations).otherwise(size)
    ids = [F.lit(seed).cast("string"), F.col("series_id").cast("string"), F.col("tick").cast("string")]
    rows = rows.select("*", scenario.alias("scenario"), level.alias("level"), regime.alias("true_regime"), size.alias("size"), normal(F.lit("h"), *ids).alias("eps"), normal(F.lit("r"), *ids).alias("z"))
    out = ordered_fold(rows, "series_id", ["tick"], ["level", "eps"], partial(_Ar), _Ar.OUTPUTS, keep=["scenario", "true_regime", "size", "z"])
    shock = F.when(F.col("size") > 0, F.col("size") * F.signum("z")).otherwise(F.col("z"))
    return out.select("series_id", "tick", "scenario", "true_log_vol", "true_regime", (F.exp("true_log_vol") * shock).alias("ret"), (F.col("size") > 0).alias("is_outlier"))


def tape_sql(seed: int = 1) -> str:
    """The tape of series 0 in SQL."""
    u = lambda n, x: f"(('0x' || substr(md5('{n}:{x}:{seed}:0:' || tick), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    normal_of = lambda x: f"sqrt(-2 * ln({u('n1', x)} + {2.0**-33!r}::DOUBLE)) * cos({2 * math.pi!r}::DOUBLE * {u('n2', x)})"
    when = lambda e: "CASE " + " ".join(f"WHEN tick BETWEEN {a} AND {b} THEN {e(n, a, b, h0, h1, r)}" for n, a, b, h0, h1, r in SCENARIOS) + " END"
    level = when(lambda n, a, b, h0, h1, r: f"{h0!r}::DOUBLE + {h1 - h0!r}::DOUBLE * (tick - {a}) / {float(b - a)!r}::DOUBLE")
    size = "CASE tick " + " ".join(f"WHEN {t} THEN {d!r}::DOUBLE" for t, d in OUTLIERS.items()) + " ELSE 0.0::DOUBLE END"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT tick, {when(lambda n, *_: f"'{n}'")} AS scenario, {when(lambda *x: x[5])} AS true_regime, {level} AS level, {size} AS size, {normal_of('h')} AS eps, {normal_of('r')} AS z
      FROM (SELECT unnest(range(7500))::INT AS tick)), f AS (SELECT tick, level AS h FROM t WHERE tick = 0
      UNION ALL SELECT t.tick, 0.95::DOUBLE * h + 0.05::DOUBLE * level + 0.08::DOUBLE * eps FROM f JOIN t ON t.tick = f.tick + 1)
    SELECT tick, scenario, round(h, 8) AS true_log_vol, true_regime, round(exp(h) * CASE WHEN size > 0 THEN size * sign(z) ELSE z END, 9) + 0.0 AS ret, size > 0 AS is_outlier FROM f JOIN t USING (tick)"""


def stochastic_volatility(spark: SparkSession, days: int, vol: float, phi: float, drift: float = 0.0, seed: int = 1) -> DataFrame:
    """day, true_log_vol, ret of one series with an AR(1) log-volatility around ``log(vol)``."""
    rows = spark.range(days).select(F.lit(0).alias("series_id"), F.col("id").alias("day"), F.lit(math.log(vol)).alias("level"))
    ids = [F.lit(seed).cast("string"), F.col("day").cast("string")]
    rows = rows.select("*", normal(F.lit("h"), *ids).alias("eps"), normal(F.lit("r"), *ids).alias("z"))
    out = ordered_fold(rows, "series_id", ["day"], ["level", "eps"], partial(_Ar, 1 - phi, 0.15), _Ar.OUTPUTS, keep=["z"])
    return out.select("day", "true_log_vol", (drift + F.exp("true_log_vol") * F.col("z")).alias("ret"))


#: scenario: level of log-volatility as SQL over tick t (0 to 499).
MARKET = {
    "flash_crash": "CASE WHEN t BETWEEN 250 AND 264 THEN -2.8 WHEN t BETWEEN 265 AND 300 THEN -3.8 ELSE -4.8 END",
    "announcement": "CASE WHEN t >= 200 THEN -4.8 + 1.6 * exp(-(t - 200) / 40) ELSE -4.8 - 0.3 * t / 200 END",
    "gap": "CASE WHEN t = 250 THEN -2.5 WHEN t > 250 THEN -4.2 ELSE -4.8 END",
    "liquidity": "CASE WHEN t BETWEEN 150 AND 350 THEN -4.8 + 1.2 * (t - 150) / 200 WHEN t > 350 THEN -3.6 ELSE -4.8 END",
    "gradual": "-5.2 + 1.6 * t / 499",
    "overnight": "CASE WHEN t % 100 = 0 THEN -3.4 ELSE -4.8 END",
    "intraday": "-4.8 + 0.6 * cos(2 * pi() * (t % 100) / 100)",
    "correlation": "CASE WHEN t >= 250 THEN -3.9 ELSE -4.9 END",
    "oscillating": "CASE WHEN t DIV 50 % 2 = 0 THEN -5.0 ELSE -4.0 END",
    "fat_tail": "-4.6",
}


def market_scenarios(spark: SparkSession, ticks: int = 500, seed: int = 1) -> DataFrame:
    """scenario, tick, true_log_vol, ret of ten market scenarios; tails of ``fat_tail`` are those of a t with four degrees."""
    names = spark.createDataFrame([(n,) for n in MARKET], "scenario string")
    rows = spark.range(ticks).select(F.col("id").cast("int").alias("t")).crossJoin(F.broadcast(names))
    level = "CASE scenario " + " ".join(f"WHEN '{n}' THEN {e}" for n, e in MARKET.items()) + " END"
    ids = [F.lit(seed).cast("string"), F.col("scenario"), F.col("t").cast("string")]
    squares = sum((normal(F.lit(f"c{i}"), *ids) ** 2 for i in range(1, 4)), normal(F.lit("c0"), *ids) ** 2)
    heavy = F.when(F.col("scenario") == "fat_tail", F.sqrt(F.lit(2.0) / squares)).otherwise(1.0)
    return rows.select("scenario", F.col("t").alias("tick"), F.expr(level).cast("double").alias("true_log_vol"), normal(F.lit("r"), *ids).alias("z"), heavy.alias("k")).select("scenario", "tick", "true_log_vol", (F.exp("true_log_vol") * F.col("z") * F.col("k")).alias("ret"))
