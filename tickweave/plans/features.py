"""Queries: returns, bars, windows, session profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import features as f
from tickweave.plans.registry import query, rounded
from tickweave.sources import ticks as s

KEY, ORDER = "series_id", ["ts", "seq"]


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([s.TICKS_SQL, *more])} {body}"


@query(sql("SELECT series_id, seq, round(px / nullif(lag(px) OVER (PARTITION BY series_id ORDER BY ts, seq), 0) - 1, 9) + 0.0 AS simple_ret FROM ticks"))
def simple_returns(spark, sf_dir):
    return f.simple_returns(s.ticks(spark, sf_dir), KEY, ORDER, "px", "x").select(KEY, "seq", rounded("x").alias("simple_ret"))


@query(sql("SELECT series_id, seq, round(ret, 9) + 0.0 AS ret FROM ticks"))
def log_returns(spark, sf_dir):
    return s.ticks(spark, sf_dir).select(KEY, "seq", rounded("ret").alias("ret"))


@query(sql("SELECT series_id, seq, round(CASE WHEN abs(ret) < 1e-10 THEN -23.0 ELSE ln(ret * ret) END, 8) + 0.0 AS y FROM r"))
def logsq_obs(spark, sf_dir):
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(f.log_square(F.col("ret")), 8).alias("y"))


@query(sql("SELECT series_id, seq, ret FROM (SELECT series_id, seq, round(ret, 9) + 0.0 AS ret FROM r WHERE isfinite(ret) AND abs(ret) < 0.03)"))
def drop_bad_ticks(spark, sf_dir):
    rows = s.returns(spark, sf_dir).where(f.finite(F.col("ret")) & (F.abs("ret") < 0.03))
    return rows.select(KEY, "seq", rounded("ret").alias("ret"))


@query(sql("SELECT series_id, seq, round(CASE WHEN abs(ret) < 0.002 THEN CASE WHEN ret < 0 THEN -0.002 ELSE 0.002 END ELSE ret END, 9) + 0.0 AS clamped FROM r"))
def zero_clamp(spark, sf_dir):
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(f.zero_clamp(F.col("ret"), 0.002)).alias("clamped"))


@query(sql("""SELECT r.series_id, seq, round(greatest(least(ret, m + 1.5 * d), m - 1.5 * d), 9) + 0.0 AS clipped
  FROM r JOIN (SELECT series_id, avg(ret) AS m, stddev_pop(ret) AS d FROM r GROUP BY series_id) b USING (series_id)"""))
def winsorize(spark, sf_dir):
    return f.winsorize(s.returns(spark, sf_dir), KEY, "ret", 1.5, "x").select(KEY, "seq", rounded("x").alias("clipped"))


@query(sql("""SELECT r.series_id, seq, abs(ret - m) > 2.0 * d AS outlier
  FROM r JOIN (SELECT series_id, avg(ret) AS m, stddev_pop(ret) AS d FROM r GROUP BY series_id) b USING (series_id)"""))
def outlier_flags(spark, sf_dir):
    return f.outlier_flags(s.returns(spark, sf_dir), KEY, "ret", 2.0, "outlier").select(KEY, "seq", "outlier")


@query(sql("SELECT series_id, day::VARCHAR AS day, open, high, low, close, round(volume, 6) AS volume FROM bars", s.BARS_SQL))
def ohlcv_bars(spark, sf_dir):
    return s.bars(spark, sf_dir).withColumn("volume", F.round("volume", 6)).withColumn("day", F.col("day").cast("string"))


@query(sql("SELECT series_id, day::VARCHAR AS day, round((high - low) / nullif(close, 0), 9) AS range_pct FROM bars", s.BARS_SQL))
def range_pct(spark, sf_dir):
    return s.bars(spark, sf_dir).select(KEY, F.col("day").cast("string").alias("day"), F.round(F.try_divide(F.col("high") - F.col("low"), F.col("close")), 9).alias("range_pct"))


@query(sql("SELECT series_id, day::VARCHAR AS day, round(open / nullif(lag(close) OVER (PARTITION BY series_id ORDER BY day), 0) - 1, 9) + 0.0 AS gap FROM bars", s.BARS_SQL))
def price_gap(spark, sf_dir):
    before = F.lag("close").over(f.by(KEY, ["day"]))
    return s.bars(spark, sf_dir).select(KEY, F.col("day").cast("string").alias("day"), rounded(F.try_divide(F.col("open"), before) - 1).alias("gap"))


@query(sql("SELECT series_id, seq, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY series_id ORDER BY ts, seq)) - 1, 8) + 0.0 AS cum_ret FROM r"))
def cum_return(spark, sf_dir):
    return f.cumulative_return(s.returns(spark, sf_dir), KEY, ORDER, "ret", "x").select(KEY, "seq", rounded("x", 8).alias("cum_ret"))


def _rolling(rows: int, annualise: bool) -> str:
    scale = " * sqrt(252.0)" if annualise else ""
    return sql(f"""SELECT series_id, seq, CASE WHEN rn >= {rows} THEN round(stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS {rows - 1} PRECEDING){scale}, 8) END AS vol FROM r""")


@query(_rolling(20, False))
def realized_vol_20(spark, sf_dir):
    return f.rolling_std(s.returns(spark, sf_dir), KEY, ORDER, "ret", 20, "x").select(KEY, "seq", rounded("x", 8).alias("vol"))


@query(_rolling(60, True))
def realized_vol_60(spark, sf_dir):
    return f.rolling_std(s.returns(spark, sf_dir), KEY, ORDER, "ret", 60, "x", annualise=True).select(KEY, "seq", rounded("x", 8).alias("vol"))


@query(sql("SELECT series_id, seq, round(avg(px) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 7) AS mean_px FROM ticks"))
def moving_avg_centered(spark, sf_dir):
    return f.centred_mean(s.ticks(spark, sf_dir), KEY, ORDER, "px", 3, "x").select(KEY, "seq", rounded("x", 7).alias("mean_px"))


@query(sql("""SELECT series_id, seq, CASE WHEN rn >= 5 THEN lag(px, 4) OVER (PARTITION BY series_id ORDER BY ts, seq) ELSE px END AS smooth, rn >= 5 AS smooth_valid FROM r"""))
def fixed_lag_output(spark, sf_dir):
    return f.fixed_lag(s.returns(spark, sf_dir), KEY, ORDER, "px", 5, "smooth").select(KEY, "seq", "smooth", "smooth_valid")


_BIN_SQL = "binned AS (SELECT *, ((greatest(least(hour(ts) * 60 + minute(ts), 1199), 240) - 240) * 24 // 960)::INT AS bin FROM r)"
_PROFILE_SQL = """sums AS (SELECT bin, sum(ret * ret) AS s, count(*) AS n FROM binned GROUP BY bin),
  raw AS (SELECT b.bin, greatest(least(CASE WHEN coalesce(n, 0) < 10 THEN 1.0 ELSE sqrt(s / n) / (SELECT sqrt(sum(s) / sum(n)) FROM sums) END, 3.0), 0.3) AS raw
          FROM (SELECT unnest(range(24))::INT AS bin) b LEFT JOIN sums USING (bin)),
  profile AS (SELECT bin, avg(raw) OVER (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS factor FROM raw)"""


def _binned(spark, sf_dir):
    return s.returns(spark, sf_dir).withColumn("bin", f.minute_bin(F.col("ts"), 240, 1200, 24))


@query(sql("SELECT bin, count(*) AS n FROM binned GROUP BY bin", _BIN_SQL))
def session_bins(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT bin, round(factor, 8) AS factor FROM profile", _BIN_SQL, _PROFILE_SQL))
def diurnal_profile(spark, sf_dir):
    return f.diurnal_profile(_binned(spark, sf_dir), "bin", "ret", 24).select("bin", rounded("factor", 8).alias("factor"))


@query(sql("SELECT series_id, seq, round(ret / factor, 8) + 0.0 AS adjusted FROM binned JOIN profile USING (bin)", _BIN_SQL, _PROFILE_SQL))
def diurnal_adjust(spark, sf_dir):
    rows = _binned(spark, sf_dir)
    profile = f.diurnal_profile(rows, "bin", "ret", 24)  # 24 rows
    return rows.join(F.broadcast(profile), "bin").select(KEY, "seq", rounded(F.col("ret") / F.col("factor"), 8).alias("adjusted"))


@query("""WITH t AS (SELECT unnest(range(78))::INT AS bin), u AS (SELECT bin, bin / 77.0::DOUBLE AS t FROM t),
  v AS (SELECT bin, 0.8 + 0.6 * exp(-50 * t * t) + 0.5 * exp(-50 * (1 - t) * (1 - t)) - 0.3 * exp(-20 * (t - 0.5) * (t - 0.5)) AS shape FROM u)
  SELECT bin, round(shape / avg(shape) OVER (), 9) AS factor FROM v""")
def ushape_factors(spark, sf_dir):
    return f.ushape(spark, 78).select("bin", rounded("factor").alias("factor"))


@query(f"""WITH {s.DAILY_SQL}, wide AS (SELECT ts, max(px) FILTER (series_id = '1-URGENT') AS urgent, max(px) FILTER (series_id = '2-HIGH') AS high, max(px) FILTER (series_id = '5-LOW') AS low FROM days GROUP BY ts)
  SELECT ts::DATE::VARCHAR AS ts, round(urgent, 4) AS urgent, round(high, 4) AS high, round(low, 4) AS low FROM wide WHERE urgent IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL""")
def multi_series_align(spark, sf_dir):
    days = s.daily(spark, sf_dir)
    names = {"urgent": "1-URGENT", "high": "2-HIGH", "low": "5-LOW"}
    out = s.align({n: days.where(F.col("series_id") == p) for n, p in names.items()}, price="px")
    return out.select(F.to_date("ts").cast("string").alias("ts"), *[F.round(n, 4).alias(n) for n in names])


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return s.ticks(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
