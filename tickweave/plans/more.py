"""Queries: tempering, session learning, alignment, weights, presets, SQL functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave.functions import presets as ps
from tickweave.functions import register as rg
from tickweave.functions import special as sp
from tickweave.operators import durations as du
from tickweave.operators import features as f
from tickweave.operators import kernels as k
from tickweave.operators import particles as pt
from tickweave.operators import reports as rp
from tickweave.operators.fold import aligned_fold, ordered_fold, ordered_reduce
from tickweave.plans.features import _BIN_SQL, _binned
from tickweave.plans.folds import KEY, ORDER, fold_sql, labelled, mixture_sql, p2_ctes
from tickweave.plans.registry import query, rounded
from tickweave.plans.reports import _FC, MODELS, long_forecasts, sql
from tickweave.runtime import Scratch
from tickweave.sources import sinks, synthetic
from tickweave.sources import ticks as s
from tickweave.streaming import runner


_DAMPED = "CASE WHEN x > ln(256) THEN ln(256) / x WHEN rn > 20 AND high > 0 AND x > high THEN high / x ELSE 1.0::DOUBLE END"


@query(f"""WITH RECURSIVE {s.TICKS_SQL}, {p2_ctes('r', 'abs(ret) * 300', 0.95)},
  h AS (SELECT *, CASE WHEN rn > 5 THEN lag(quantile) OVER (PARTITION BY series_id ORDER BY rn) ELSE 0 END AS high FROM p2),
  d AS (SELECT *, greatest({_DAMPED}, 0.1::DOUBLE) AS temper FROM h),
  g AS (SELECT *, sum((temper = 1)::INT) OVER (PARTITION BY series_id ORDER BY rn) AS island FROM d)
  SELECT series_id, seq, round(temper, 9) AS temper, round(quantile, 7) AS p95,
    temper < 1 AND sum((temper < 1)::INT) OVER (PARTITION BY series_id, island ORDER BY rn) % 11 = 0 AS stuck FROM g""")
def kl_tempering(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("kl", F.abs("ret") * 300)
    out = ordered_fold(rows, KEY, ORDER, ["kl"], partial(k.KlTempering, wait=20), k.KlTempering.OUTPUTS)
    return out.select(KEY, "seq", rounded("temper").alias("temper"), rounded("p95", 7).alias("p95"), "stuck")


def _diurnal_online_sql() -> str:
    """The recursion with the bins' counts and levels as lists."""
    one = "list_transform(range(24), lambda i: CASE WHEN i <> bin THEN {other} ELSE {own} END)"
    joined = "SELECT t.*, n, v, w FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1"
    step = f"SELECT *, CASE WHEN n[bin + 1] >= 2 AND w > 0 THEN least(greatest(sqrt(v[bin + 1] / w), 0.3::DOUBLE), 3.0::DOUBLE) ELSE 1.0::DOUBLE END AS factor FROM ({joined})"
    step = f"""SELECT series_id, seq, rn, {one.format(other='n[i + 1]', own='n[i + 1] + 1')} AS n,
      {one.format(other='v[i + 1]', own='CASE WHEN n[i + 1] = 0 THEN ret * ret ELSE 0.02::DOUBLE * ret * ret + 0.98::DOUBLE * v[i + 1] END')} AS v, 0.02::DOUBLE * ret * ret + 0.98::DOUBLE * w AS w, factor, ret / factor AS adjusted FROM ({step})"""
    first = f"SELECT series_id, seq, rn, {one.format(other='0', own='1')} AS n, {one.format(other='0.0::DOUBLE', own='ret * ret')} AS v, ret * ret AS w, 1.0::DOUBLE AS factor, ret AS adjusted FROM t WHERE rn = 1"
    return f"WITH RECURSIVE {s.TICKS_SQL}, {_BIN_SQL}, t AS MATERIALIZED (SELECT series_id, seq, rn, ret, bin FROM binned), f AS ({first} UNION ALL {step}) SELECT series_id, seq, round(factor, 9) AS factor, round(adjusted, 9) + 0.0 AS adjusted FROM f"


@query(_diurnal_online_sql())
def diurnal_online(spark, sf_dir):
    out = ordered_fold(_binned(spark, sf_dir), KEY, ORDER, ["ret", "bin"], partial(k.OnlineDiurnal, least=2), k.OnlineDiurnal.OUTPUTS)
    return out.select(KEY, "seq", rounded("factor").alias("factor"), rounded("adjusted").alias("adjusted"))


@query()
def hawkes_mle(spark, sf_dir):
    rows = s.returns(spark, sf_dir).where(F.abs("ret") > 0.01).withColumn("hours", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9))
    out = ordered_reduce(rows, KEY, ORDER, ["hours"], k.HawkesMle, k.HawkesMle.OUTPUTS)
    return out.select(KEY, *[rounded(c, 6).alias(c) for c in ("mu", "alpha", "beta", "loglik")], "n_events")


@query()
def smoothed_learning(spark, sf_dir):
    out = ordered_fold(labelled(spark, sf_dir), KEY, ORDER, ["y"], partial(pt.SmoothedLearner, n=64, lag=10), pt.SmoothedLearner.OUTPUTS, keyed=True)
    return out.select(KEY, "seq", rounded("log_vol", 8).alias("log_vol"), rounded("smooth", 8).alias("smooth"), "regime", F.transform("mu", lambda x: F.round(x, 8)).alias("mu"))


@query()
def shock_teleport(spark, sf_dir):
    out = aligned_fold(labelled(spark, sf_dir), KEY, ORDER, ["y"], partial(pt.ShockedBank, n=128, limit=4.5), pt.ShockedBank.OUTPUTS)
    return out.select(KEY, "seq", *[rounded(c, 8).alias(c) for c in ("log_vol", "surprise", "moved")])


@query()
def catch_up(spark, sf_dir):
    """The filter sees two ticks of three; through the third the cloud is carried unseen."""
    rows = labelled(spark, sf_dir).withColumn("rn", F.row_number().over(f.by(KEY, ORDER)))
    rows = rows.withColumn("y", F.when(F.col("rn") % 3 != 0, F.col("y")))
    out = aligned_fold(rows, KEY, ORDER, ["y"], partial(pt.CatchUpBank, n=128), pt.CatchUpBank.OUTPUTS)
    return out.select(KEY, "seq", rounded("log_vol", 8).alias("log_vol"), "seen")


@query(sql("SELECT series_id, round(-abs(ret) * 100 + 0.5 * (ret * 50), 9) AS w, rn AS i FROM r"))
def deferred_weights(spark, sf_dir):
    """Log weights with tempered increments added, for every return of every series."""
    rows = s.returns(spark, sf_dir).withColumn("i", F.row_number().over(f.by(KEY, ORDER)).cast("long"))
    return rows.select(KEY, rounded(-F.abs("ret") * 100 + 0.5 * (F.col("ret") * 50)).alias("w"), "i")


_ALIGN = """m AS (SELECT (rn > 40)::INT AS part, regime, avg(y) AS mu, count(*) AS n FROM regimes GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY mu) AS rank FROM m)"""


@query(sql("SELECT a.rank, a.regime AS regime_a, b.regime AS regime_b, round(b.mu - a.mu, 7) AS d_mu FROM k a JOIN k b USING (rank) WHERE a.part = 0 AND b.part = 1", _ALIGN))
def label_alignment(spark, sf_dir):
    """Regimes of the first and later ticks matched by the rank of their level."""
    rows = labelled(spark, sf_dir).withColumn("part", (F.row_number().over(f.by(KEY, ORDER)) > 40).cast("int"))
    levels = rows.groupBy("part", "regime").agg(F.avg("y").alias("mu"))
    ranked = levels.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("mu")).cast("long"))
    a, b = ranked.where("part = 0"), ranked.where("part = 1")
    both = a.select("rank", F.col("regime").alias("regime_a"), F.col("mu").alias("x")).join(b.select("rank", F.col("regime").alias("regime_b"), F.col("mu").alias("z")), "rank")
    return both.select("rank", "regime_a", "regime_b", rounded(F.col("z") - F.col("x"), 7).alias("d_mu"))


_METRICS = ", ".join(f"max(v) FILTER (model = '{m}') AS {m}" for m in MODELS)


@query(f"""{_FC}, l AS (SELECT model, sqrt(avg((truth - forecast) ** 2)) AS rmse, avg(abs(truth - forecast)) AS mae, avg(ln(greatest(forecast ** 2, 1e-10)) + truth ** 2 / greatest(forecast ** 2, 1e-10)) AS qlike FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL GROUP BY model),
  u AS (SELECT model, unnest(['rmse', 'mae', 'qlike']) AS metric, round(unnest([rmse, mae, qlike]), 7) AS v FROM l) SELECT metric, {_METRICS} FROM u GROUP BY metric""")
def method_matrix(spark, sf_dir):
    losses = rp.losses(long_forecasts(spark, sf_dir), ["model"], "truth", "forecast")
    long = losses.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 7).alias("v")) for m in ("rmse", "mae", "qlike")])).alias("x")).select("model", "x.*")
    return sinks.matrix(long, "metric", "model", "v", MODELS)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', {', '.join(f'{x!r}::DOUBLE' for x in p[1:])})" for p in ps.PRESETS) + ") AS t(asset, centre, spacing, sigma, stay, outlier, nu)")
def preset_table(spark, sf_dir):
    return ps.presets(spark)


@query(sql(f"SELECT series_id, seq, round({mixture_sql('y', '-4.2')}, 8) + 0.0 AS logpdf, round(CASE WHEN abs(ret) < 0.001 THEN CASE WHEN ret < 0 THEN -0.001 ELSE 0.001 END ELSE ret END, 9) + 0.0 AS clamped FROM regimes"))
def sql_functions(spark, sf_dir):
    rg.register(spark)
    s.returns(spark, sf_dir).createOrReplaceTempView("tw_returns")
    return spark.sql("SELECT series_id, seq, round(tw_mixture_logpdf(tw_log_square(ret), -4.2D), 8) + 0D AS logpdf, round(tw_zero_clamp(ret, 0.001D), 9) + 0D AS clamped FROM tw_returns")


@query(fold_sql("ret", "0 AS z, ret", "t.ret, CASE WHEN abs(t.ret) > 0.02 THEN f.z + 1 ELSE 0 END AS z", "z, ret", "z AS streak, abs(ret) > 0.02 AND z >= 2 AS cluster"))
def outlier_streaks(spark, sf_dir):
    """Neighbouring large returns, by gaps and islands instead of a fold."""
    rows = f.runs(s.returns(spark, sf_dir).withColumn("big", F.abs("ret") > 0.02), KEY, ORDER, "big")
    first = (F.col("run_id") == 0) & F.col("big")
    streak = F.when(F.col("big"), F.col("run_age") - first.cast("int")).otherwise(0).cast("int")
    return rows.select(KEY, "seq", streak.alias("streak"), (F.col("big") & (streak >= 2)).alias("cluster"))


@query(sql("SELECT count(DISTINCT path) AS paths, count(*) AS series FROM (SELECT series_id, list(regime ORDER BY rn) AS path FROM regimes GROUP BY series_id)"))
def trajectory_diversity(spark, sf_dir):
    """Distinct regime paths of whole series, by a digest that grows tick by tick."""
    paths = ordered_reduce(labelled(spark, sf_dir), KEY, ORDER, ["regime"], k.PathDigest, k.PathDigest.OUTPUTS)
    return paths.agg(F.countDistinct("path").alias("paths"), F.count(F.lit(1)).alias("series"))


@query("SELECT e.user_id AS series_id, count(*) AS n, coalesce(any_value(c_name), 'unknown') AS name, coalesce(any_value(c_mktsegment), 'N/A') AS sector, coalesce(any_value(n_name), 'N/A') AS country FROM events e LEFT JOIN customer ON c_custkey = e.user_id LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY e.user_id")
def series_metadata(spark, sf_dir):
    """A dimension of the series with defaults for what is unknown."""
    from tickweave.runtime import table

    about = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    counted = s.ticks(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.join(about, F.col("c_custkey") == F.col(KEY), "left")
    pick = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return rows.select(KEY, "n", pick("c_name", "unknown").alias("name"), pick("c_mktsegment", "N/A").alias("sector"), pick("n_name", "N/A").alias("country"))


@query(sql("SELECT event, count(*) AS n, round(avg(abs(ret)), 9) AS mean_abs FROM (SELECT event, ret FROM r WHERE regime_in UNION ALL SELECT 'rescue' AS event, ret FROM r WHERE abs(ret) > 0.04) GROUP BY event").replace("WHERE regime_in", "WHERE ret >= -0.02 AND ret < 0.02"))
def union_clouds(spark, sf_dir):
    """Rows within bounds joined by a second set of rows, by name."""
    rows = s.returns(spark, sf_dir)
    live = rows.where((F.col("ret") >= -0.02) & (F.col("ret") < 0.02)).select("event", "ret")
    rescue = rows.where(F.abs("ret") > 0.04).select("ret", F.lit("rescue").alias("event"))
    return live.unionByName(rescue).groupBy("event").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs("ret"))).alias("mean_abs"))


_DUR = """sw AS (SELECT *, coalesce(regime <> lag(regime) OVER (PARTITION BY series_id ORDER BY rn), false) AS switched FROM regimes),
  ru AS (SELECT *, sum(switched::INT) OVER (PARTITION BY series_id ORDER BY rn) AS run_id FROM sw),
  le AS (SELECT series_id, run_id, any_value(regime) AS state, count(*) AS age, run_id < max(run_id) OVER (PARTITION BY series_id) AS closed FROM ru GROUP BY series_id, run_id),
  en AS (SELECT state, age, sum(closed::INT) AS ended, count(*) AS gone FROM le GROUP BY state, age),
  ha AS (SELECT *, sum(gone) OVER (PARTITION BY state ORDER BY age DESC) AS at_risk FROM en)"""


@query(sql("""SELECT state, age, at_risk::BIGINT AS at_risk, round(ended / at_risk, 9) AS hazard,
  round(exp(sum(CASE WHEN ended < at_risk THEN ln(1 - ended / at_risk) ELSE -1000 END) OVER (PARTITION BY state ORDER BY age)), 9) AS survival,
  round(sum(gone * age) OVER (PARTITION BY state ORDER BY age ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / at_risk - age, 8) + 0.0 AS remaining FROM ha""", _DUR))
def duration_hazard(spark, sf_dir):
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime")
    lengths = rows.groupBy(KEY, "run_id").agg(F.first("regime").alias("state"), F.count(F.lit(1)).alias("length"))
    lengths = lengths.withColumn("closed", F.col("run_id") < F.max("run_id").over(Window.partitionBy(KEY)))
    out = du.duration_table(lengths, "state", "length", "closed")
    return out.select("state", "age", "at_risk", rounded("hazard").alias("hazard"), rounded("survival").alias("survival"), rounded("remaining", 8).alias("remaining"))


@query(sql("""SELECT series_id, seq, age, round(ended / at_risk, 9) AS hazard, round(left_, 8) + 0.0 AS remaining FROM (
  SELECT a.series_id, a.seq, a.rn - min(a.rn) OVER (PARTITION BY a.series_id, a.run_id) + 1 AS age, a.regime, a.rn FROM ru a) x
  ASOF JOIN (SELECT *, sum(gone * age) OVER (PARTITION BY state ORDER BY age ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / at_risk - age AS left_ FROM (SELECT state, age AS age, ended, gone, at_risk FROM ha)) h
  ON x.regime = h.state AND x.age <= h.age""", _DUR).replace("SELECT series_id, seq, age, round(", "SELECT x.series_id, x.seq, x.age, round("))
def duration_features(spark, sf_dir):
    """Age of every tick's regime with the hazard and the expected remaining time at that age."""
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime")
    lengths = rows.groupBy(KEY, "run_id").agg(F.first("regime").alias("state"), F.count(F.lit(1)).alias("length"))
    lengths = lengths.withColumn("closed", F.col("run_id") < F.max("run_id").over(Window.partitionBy(KEY)))
    out = du.with_duration(rows, du.duration_table(lengths, "state", "length", "closed"), "regime", "run_age")
    return out.select(KEY, "seq", F.col("run_age").cast("long").alias("age"), rounded("hazard").alias("hazard"), rounded("remaining", 8).alias("remaining"))


@query(sql("SELECT regime, count(*) AS n, round(sum(y), 5) AS s, round(sum(y * y), 4) AS ss, round(sum(y - 0.9 * b), 5) AS e, round(sum((y - 0.9 * b) ** 2), 4) AS ee, round(sum(y * b), 4) AS x FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY rn) AS b FROM regimes) WHERE b IS NOT NULL GROUP BY regime"))
def regime_statistics(spark, sf_dir):
    out = du.regime_statistics(labelled(spark, sf_dir), KEY, ORDER, "regime", "y", 0.1)
    return out.select("regime", "n", rounded("s", 5).alias("s"), rounded("ss", 4).alias("ss"), rounded("e", 5).alias("e"), rounded("ee", 4).alias("ee"), rounded("cross", 4).alias("x"))


@query(sql("""SELECT series_id, round(m, 8) + 0.0 AS mean, round(q - m * m + v, 8) AS variance, round(x, 8) AS vol, round(n1 * n1 / n2, 6) AS ess FROM (
  SELECT series_id, sum(w * y) / sum(w) AS m, sum(w * y * y) / sum(w) AS q, sum(w * 0.05) / sum(w) AS v, sum(w * exp(y / 2 + 0.025)) / sum(w) AS x, sum(w) AS n1, sum(w * w) AS n2 FROM (SELECT *, exp(-abs(ret) * 50) AS w FROM regimes) GROUP BY series_id)"""))
def mixture_moments(spark, sf_dir):
    """Mean, total variance, mean volatility and effective size of weighted normals, a row per component."""
    rows = labelled(spark, sf_dir).withColumn("w", F.exp(-F.abs("ret") * 50))
    w, y = F.col("w"), F.col("y")
    each = rows.groupBy(KEY).agg(F.sum(w).alias("n1"), F.sum(w * w).alias("n2"), F.sum(w * y).alias("a"), F.sum(w * y * y).alias("b"), F.sum(w * 0.05).alias("v"), F.sum(w * F.exp(y / 2 + 0.025)).alias("x"))
    mean = F.col("a") / F.col("n1")
    return each.select(KEY, rounded(mean, 8).alias("mean"), rounded(F.col("b") / F.col("n1") - mean * mean + F.col("v") / F.col("n1"), 8).alias("variance"), rounded(F.col("x") / F.col("n1"), 8).alias("vol"), rounded(F.col("n1") * F.col("n1") / F.col("n2"), 6).alias("ess"))


@query(sql("""SELECT series_id, round(sum(p * ln(p / q)), 9) + 0.0 AS kl, round(-sum(p * ln(p)), 9) + 0.0 AS entropy FROM (
  SELECT series_id, regime, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS p FROM regimes GROUP BY series_id, regime) JOIN (SELECT regime, count(*) / sum(count(*)) OVER () AS q FROM regimes GROUP BY regime) USING (regime) GROUP BY series_id"""))
def regime_share_kl(spark, sf_dir):
    """Divergence of each series' regime shares from those of all."""
    rows = labelled(spark, sf_dir).groupBy(KEY, "regime").agg(F.count(F.lit(1)).alias("n"))
    own = rows.groupBy(KEY).agg(F.sum("n").alias("own"))
    every = rows.groupBy("regime").agg(F.sum("n").alias("r"))
    total = every.agg(F.sum("r").alias("t"))
    shares = rows.join(own, KEY).join(every.crossJoin(total), "regime").select(KEY, (F.col("n") / F.col("own")).alias("p"), (F.col("r") / F.col("t")).alias("q"))
    return shares.groupBy(KEY).agg(rounded(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"), rounded(-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


@query(sql("SELECT series_id, seq, round(ln((x - 0.5) / (1.2 - x)), 8) + 0.0 AS logit, round(0.5 + 0.7 / (1 + exp(-ret * 70)), 8) AS back, round(4 * ln(x / 1.3) + 2 * ln(1 - x / 1.3), 8) + 0.0 AS log_beta FROM (SELECT *, 0.85 + ret AS x FROM r)"))
def bounded_transforms(spark, sf_dir):
    x = 0.85 + F.col("ret")
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.logit_on(x, 0.5, 1.2), 8).alias("logit"), rounded(sp.inverse_logit_on(F.col("ret") * 70, 0.5, 1.2), 8).alias("back"), rounded(sp.log_beta_density(x / 1.3, 5.0, 3.0), 8).alias("log_beta"))


@query("""SELECT user_id AS series_id, ts::DATE::VARCHAR AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events
  WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_bars(spark, sf_dir):
    """Daily bars of the replayed stream: the days that the watermark has closed."""
    bars = runner.run_to_end(runner.windowed_bars(runner.event_stream(spark, sf_dir)), Scratch(spark, "bars"), "bars")
    return bars.select(KEY, F.to_date("start").cast("string").alias("day"), "open", "high", "low", "close", "n")


@query()
def market_scenarios(spark, sf_dir):
    """Ten market scenarios and how well the filter follows each."""
    tape = synthetic.market_scenarios(spark).withColumn("y", f.log_square(F.col("ret")))
    rows = aligned_fold(tape, "scenario", ["tick"], ["y"], partial(pt.Bank, n=256, outlier=(0.02, 30.0)), pt.Bank.OUTPUTS, keep=["true_log_vol"])
    error = F.col("log_vol") - F.col("true_log_vol")
    return rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(F.max("surprise"), 6).alias("worst_surprise"))
