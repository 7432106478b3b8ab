"""Queries: forecast comparison, confusion, transitions, detection and range joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickweave.functions import special as sp
from tickweave.operators import features as f
from tickweave.operators import kernels as k
from tickweave.operators import ranges as rg
from tickweave.operators import reports as rp
from tickweave.operators.fold import ordered_fold
from tickweave.plans.folds import CUTS, KEY, ORDER, REGIME_SQL, digamma_sql, fold_sql, labelled, mixture_sql
from tickweave.plans.registry import query, rounded
from tickweave.sources import ticks as s

HALFLIVES = (10, 20, 60)


class Forecasts:
    """Exponentially weighted volatilities of several half-lives, each as of the tick before."""

    OUTPUTS = ", ".join(f"ewma{h} double" for h in HALFLIVES)

    def __init__(self):
        self.parts = [k.Ewma(h) for h in HALFLIVES]
        self.last = [None] * len(HALFLIVES)

    def step(self, r):
        out = self.last
        self.last = [p.step(r)[1] for p in self.parts]
        return tuple(out)


def forecasts(spark, sf_dir):
    """Truth (deviation of the ten ticks from this one on) and each model's forecast, a column each."""
    rows = ordered_fold(s.returns(spark, sf_dir), KEY, ORDER, ["ret"], Forecasts, Forecasts.OUTPUTS, keep=["ret"])
    ahead = f.by(KEY, ORDER).rowsBetween(0, 9)
    rows = rows.withColumn("truth", F.when(F.count("ret").over(ahead) == 10, F.stddev_samp("ret").over(ahead)))
    before = f.by(KEY, ORDER).rowsBetween(-20, -1)
    return rows.withColumn("rv20", F.when(F.count("ret").over(before) == 20, F.stddev_samp("ret").over(before))).withColumn("constant", F.lit(0.0145))


MODELS = [*(f"ewma{h}" for h in HALFLIVES), "rv20", "constant"]


def _forecast_ctes() -> str:
    rates = {h: 1 - math.exp(-math.log(2) / h) for h in HALFLIVES}
    first = ", ".join(f"ret * ret AS v{h}" for h in HALFLIVES)
    step = ", ".join(f"{a!r}::DOUBLE * ret * ret + {1 - a!r}::DOUBLE * v{h} AS v{h}" for h, a in rates.items())
    state = ", ".join(f"v{h}" for h in HALFLIVES)
    lagged = ", ".join(f"sqrt(lag(v{h}) OVER w) AS ewma{h}" for h in HALFLIVES)
    fold = fold_sql("ret", f"{first}, ret", f"ret, {step}".replace("ret,", "t.ret,", 1).replace("* ret * ret", "* t.ret * t.ret"), f"{state}, ret", f"rn, ret, {state}")
    head, tail = fold.rsplit(") SELECT", 1)
    return f"""{head}), e AS (SELECT {tail}), fc AS (
      SELECT series_id, seq, rn, ret, {lagged},
        CASE WHEN count(ret) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) = 10 THEN stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) END AS truth,
        CASE WHEN rn > 20 THEN stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS rv20, 0.0145::DOUBLE AS constant
      FROM e WINDOW w AS (PARTITION BY series_id ORDER BY rn)
    ), long AS (SELECT series_id, seq, truth, unnest([{', '.join(repr(m) for m in MODELS)}]) AS model, unnest([{', '.join(MODELS)}]) AS forecast FROM fc)"""


_FC = _forecast_ctes()


def long_forecasts(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    return rows.select(KEY, "seq", "truth", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast")) for m in MODELS])).alias("m")).select(KEY, "seq", "truth", "m.model", "m.forecast")


_LOSS = "sqrt(avg((truth - forecast) ** 2)) AS rmse, avg(abs(truth - forecast)) AS mae, avg(ln(greatest(forecast ** 2, 1e-10)) + truth ** 2 / greatest(forecast ** 2, 1e-10)) AS qlike, count(*) AS n"
_ROUND = "round(rmse, 9) AS rmse, round(mae, 9) AS mae, round(qlike, 7) AS qlike, n"
_MZ = "count(*) AS n, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, (regr_slope(y, x) - 1) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t_beta"


def _rounded_losses(frame, *keys):
    return frame.select(*keys, rounded("rmse").alias("rmse"), rounded("mae").alias("mae"), rounded("qlike", 7).alias("qlike"), "n")


@query(f"{_FC} SELECT a.model, {_ROUND}, round(alpha, 9) + 0.0 AS alpha, round(beta, 7) AS beta, round(r2, 7) AS r2 FROM (SELECT model, {_LOSS} FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL GROUP BY model) a JOIN (SELECT model, regr_intercept(truth ** 2, forecast ** 2) AS alpha, regr_slope(truth ** 2, forecast ** 2) AS beta, regr_r2(truth ** 2, forecast ** 2) AS r2 FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL AND model <> 'constant' GROUP BY model) b USING (model)")
def model_compare(spark, sf_dir):
    """The flagship: every forecast's losses and forecast efficiency."""
    rows = long_forecasts(spark, sf_dir)
    mz = rp.mincer_zarnowitz(rows.where("model <> 'constant'"), ["model"], "truth", "forecast").drop("n")
    both = rp.losses(rows, ["model"], "truth", "forecast").join(mz, "model")
    return both.select("model", rounded("rmse").alias("rmse"), rounded("mae").alias("mae"), rounded("qlike", 7).alias("qlike"), "n", rounded("alpha").alias("alpha"), rounded("beta", 7).alias("beta"), rounded("r2", 7).alias("r2"))


@query(f"{_FC} SELECT series_id, model, {_ROUND} FROM (SELECT series_id, model, {_LOSS} FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL GROUP BY ALL)")
def rmse_mae(spark, sf_dir):
    return _rounded_losses(rp.losses(long_forecasts(spark, sf_dir), [KEY, "model"], "truth", "forecast"), KEY, "model")


@query(f"{_FC} SELECT model, round(avg(ln(greatest(forecast ** 2, 1e-10)) + truth ** 2 / greatest(forecast ** 2, 1e-10)), 7) AS qlike FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL GROUP BY model")
def qlike(spark, sf_dir):
    return rp.losses(long_forecasts(spark, sf_dir), ["model"], "truth", "forecast").select("model", rounded("qlike", 7).alias("qlike"))


@query(f"{_FC} SELECT model, n, round(alpha, 9) + 0.0 AS alpha, round(beta, 7) AS beta, round(r2, 7) AS r2, round(t_beta, 5) AS t_beta FROM (SELECT model, {_MZ} FROM (SELECT model, truth ** 2 AS y, forecast ** 2 AS x FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL AND model <> 'constant') GROUP BY model)")
def mincer_zarnowitz(spark, sf_dir):
    out = rp.mincer_zarnowitz(long_forecasts(spark, sf_dir).where("model <> 'constant'"), ["model"], "truth", "forecast")
    return out.select("model", "n", rounded("alpha").alias("alpha"), rounded("beta", 7).alias("beta"), rounded("r2", 7).alias("r2"), rounded("t_beta", 5).alias("t_beta"))


@query(f"""{_FC}, d AS (SELECT a.model AS a, b.model AS b, (a.truth - a.forecast) ** 2 - (b.truth - b.forecast) ** 2 AS d FROM long a JOIN long b USING (series_id, seq) JOIN fc USING (series_id, seq)
    WHERE a.model <> b.model AND fc.truth IS NOT NULL AND fc.rv20 IS NOT NULL)
  SELECT a, b, round(avg(d) * 1e6, 7) + 0.0 AS mean_diff, round(avg(d) / sqrt(var_pop(d) / count(d)), 6) + 0.0 AS statistic FROM d GROUP BY a, b""")
def dm_matrix(spark, sf_dir):
    rows = forecasts(spark, sf_dir).where("truth is not null and rv20 is not null")
    rows = rows.select(KEY, "seq", *[((F.col("truth") - F.col(m)) ** 2).alias(m) for m in MODELS])
    return rp.diebold_mariano(rows, [KEY, "seq"], MODELS).select("a", "b", rounded(F.col("mean_diff") * 1e6, 7).alias("mean_diff"), rounded("statistic", 6).alias("statistic"))


@query(f"{_FC} SELECT model, round(corr(truth, forecast), 8) AS corr FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL AND model <> 'constant' GROUP BY model")
def vol_corr(spark, sf_dir):
    rows = long_forecasts(spark, sf_dir).where("truth is not null and forecast is not null and model <> 'constant'")
    return rows.groupBy("model").agg(F.corr("truth", "forecast").alias("c")).select("model", rounded("c", 8).alias("corr"))


@query(f"{_FC}, q AS (SELECT quantile_cont(truth, 0.9) AS q FROM fc WHERE rv20 IS NOT NULL) SELECT count(*) AS n, round(avg(abs(truth - rv20)), 8) AS tail_mae, round(max(abs(truth - rv20)), 8) AS max_error, round(corr(truth, rv20), 7) AS corr FROM fc, q WHERE rv20 IS NOT NULL AND truth >= q")
def tail_metrics(spark, sf_dir):
    rows = forecasts(spark, sf_dir).where("truth is not null and rv20 is not null")
    cut = rows.agg(F.percentile("truth", 0.9).alias("q"))
    tail = rows.crossJoin(F.broadcast(cut)).where(F.col("truth") >= F.col("q"))
    error = F.abs(F.col("truth") - F.col("rv20"))
    return tail.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(error), 8).alias("tail_mae"), rounded(F.max(error), 8).alias("max_error"), rounded(F.corr("truth", "rv20"), 7).alias("corr"))


_GUESS = f"""g AS (SELECT *, CASE WHEN e < {CUTS[0]} THEN 0 WHEN e < {CUTS[1]} THEN 1 WHEN e < {CUTS[2]} THEN 2 ELSE 3 END AS guess
  FROM (SELECT *, sqrt(avg(ret * ret) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS 5 PRECEDING)) AS e FROM regimes))"""


def guessed(spark, sf_dir):
    """Labelled ticks with the regime that the last six squared returns suggest."""
    rows = labelled(spark, sf_dir).withColumn("e", F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(f.by(KEY, ORDER).rowsBetween(-5, 0))))
    return rows.withColumn("guess", F.when(F.col("e") < CUTS[0], 0).when(F.col("e") < CUTS[1], 1).when(F.col("e") < CUTS[2], 2).otherwise(3))


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([s.TICKS_SQL, REGIME_SQL, *more])} {body}"


@query(sql("SELECT regime AS truth, guess, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY regime), 9) AS share FROM g GROUP BY regime, guess", _GUESS))
def confusion_matrix(spark, sf_dir):
    return rp.confusion(guessed(spark, sf_dir), "regime", "guess").withColumn("share", rounded("share"))


@query(sql("""SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, support FROM (
  SELECT class, coalesce(count(*) FILTER (regime = class AND guess = class) / nullif(count(*) FILTER (guess = class), 0), 0) AS p, coalesce(count(*) FILTER (regime = class AND guess = class) / nullif(count(*) FILTER (regime = class), 0), 0) AS r, count(*) FILTER (regime = class) AS support
  FROM g, (SELECT unnest([0, 1, 2, 3]) AS class) GROUP BY class)""", _GUESS))
def class_report(spark, sf_dir):
    out = rp.class_report(guessed(spark, sf_dir), "regime", "guess")
    return out.select("class", rounded("precision").alias("precision"), rounded("recall").alias("recall"), rounded("f1").alias("f1"), "support")


@query(sql("SELECT regime, count(*) AS n, round(avg(e), 9) AS mean, round(stddev_samp(e), 9) AS std, round(max(e), 9) AS max, round(min(e), 9) AS min FROM g GROUP BY regime", _GUESS))
def regime_report(spark, sf_dir):
    rows = guessed(spark, sf_dir).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), F.max("e").alias("max"), F.min("e").alias("min"))
    return rows.select("regime", "n", *[rounded(c).alias(c) for c in ("mean", "std", "max", "min")])


@query(sql("SELECT series_id, count(*) AS n, quantile_disc(abs(ret), 0.5) AS x FROM r GROUP BY series_id").replace("quantile_disc(abs(ret), 0.5) AS x", "round(quantile_cont(abs(ret), 0.5), 9) AS p50, round(quantile_cont(abs(ret), 0.99), 9) AS p99, round(max(abs(ret)), 9) AS worst"))
def latency_percentiles(spark, sf_dir):
    x = F.abs("ret")
    return s.returns(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), rounded(F.percentile(x, 0.5)).alias("p50"), rounded(F.percentile(x, 0.99)).alias("p99"), rounded(F.max(x)).alias("worst"))


_RUNS = """sw AS (SELECT *, coalesce(regime <> lag(regime) OVER (PARTITION BY series_id ORDER BY ts, seq), false) AS switched FROM regimes),
  ru AS (SELECT *, sum(switched::INT) OVER (PARTITION BY series_id ORDER BY ts, seq) AS run_id FROM sw)"""


@query(sql("SELECT series_id, run_id::BIGINT AS run_id, any_value(regime) AS regime, count(*) AS length, min(seq) AS first_seq FROM ru GROUP BY series_id, run_id", _RUNS).replace("min(seq)", "arg_min(seq, rn)"))
def regime_runs(spark, sf_dir):
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime")
    return rows.groupBy(KEY, "run_id").agg(F.first("regime").alias("regime"), F.count(F.lit(1)).alias("length"), F.min_by("seq", F.struct(*ORDER)).alias("first_seq"))


@query(sql("SELECT series_id, seq, regime, least(row_number() OVER (PARTITION BY series_id, run_id ORDER BY ts, seq), 1999) AS age, row_number() OVER (PARTITION BY series_id, run_id ORDER BY ts, seq) >= 10 AS stable FROM ru", _RUNS))
def ticks_in_regime(spark, sf_dir):
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime")
    return rows.select(KEY, "seq", "regime", F.least("run_age", F.lit(1999)).cast("long").alias("age"), (F.col("run_age") >= 10).alias("stable"))


@query(sql("SELECT series_id, sum(switched::INT)::BIGINT AS switches, round(avg((regime = 3)::INT), 9) AS crisis_share FROM ru GROUP BY series_id", _RUNS))
def regime_switches(spark, sf_dir):
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime")
    return rows.groupBy(KEY).agg(F.sum(F.col("switched").cast("long")).alias("switches"), rounded(F.avg((F.col("regime") == 3).cast("int"))).alias("crisis_share"))


_COUNTS = "nx AS (SELECT regime AS from_state, lead(regime) OVER (PARTITION BY series_id ORDER BY ts, seq) AS to_state FROM regimes), tc AS (SELECT from_state, to_state, count(*) AS n FROM nx WHERE to_state IS NOT NULL GROUP BY ALL)"


@query(sql("SELECT * FROM tc", _COUNTS))
def transition_counts(spark, sf_dir):
    return rp.transition_counts(labelled(spark, sf_dir), KEY, ORDER, "regime")


@query(sql("""SELECT from_state, to_state, round(w / sum(w) OVER (PARTITION BY from_state), 9) AS p FROM (
  SELECT a AS from_state, b AS to_state, coalesce(n, 0) + 1.0 + CASE WHEN a = b THEN 49.0 ELSE 0.0 END AS w FROM (SELECT unnest(range(4))::INT AS a), (SELECT unnest(range(4))::INT AS b) LEFT JOIN tc ON from_state = a AND to_state = b)""", _COUNTS).replace("FROM (SELECT unnest(range(4))::INT AS a), (SELECT unnest(range(4))::INT AS b) LEFT", "FROM (SELECT a, b FROM (SELECT unnest(range(4))::INT AS a) CROSS JOIN (SELECT unnest(range(4))::INT AS b)) LEFT"))
def transition_matrix(spark, sf_dir):
    counts = rp.transition_counts(labelled(spark, sf_dir), KEY, ORDER, "regime")
    return rp.transition_matrix(counts, 4, 1.0, 49.0).select("from_state", "to_state", rounded("p").alias("p"))


#: Label ranges over the days of the events: label, first and last day (from the earliest), priority.
RANGES = [("warm_up", 0, 9, 1), ("selloff", 8, 14, 2), ("rebound", 13, 20, 3), ("calm", 19, 25, 4), ("shock", 22, 23, 5)]
_RANGE_SQL = "ev AS (" + " UNION ALL ".join(f"SELECT '{n}' AS label, {a} AS s, {b} AS e, {p} AS priority" for n, a, b, p in RANGES) + "), d0 AS (SELECT min(ts)::DATE AS d0 FROM ticks), dd AS (SELECT series_id, seq, datediff('day', d0, ts::DATE) AS day FROM ticks, d0)"


def _days(spark, sf_dir):
    rows = s.ticks(spark, sf_dir).select(KEY, "seq", F.to_date("ts").alias("d"))
    return rows.crossJoin(F.broadcast(rows.agg(F.min("d").alias("d0")))).select(KEY, "seq", F.datediff("d", "d0").alias("day"))


@query(f"WITH {s.TICKS_SQL}, {_RANGE_SQL} SELECT series_id, seq, arg_max(label, priority) AS label FROM dd LEFT JOIN ev ON day BETWEEN s AND e GROUP BY series_id, seq")
def event_labels(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "label string, start int, end int, priority int")
    return rg.label_ranges(_days(spark, sf_dir), ranges, "day").select(KEY, "seq", "label")


#: phase, first and last tick; the last one has no end.
PHASES = [("calm", 1, 15), ("ramp", 16, 30), ("crisis", 31, 40), ("recovery", 41, 60), ("tail", 61, (1 << 62) - 1)]
_PHASE_SQL = "ph AS (" + " UNION ALL ".join(f"SELECT '{n}' AS phase, {a}::BIGINT AS s, {b}::BIGINT AS e" for n, a, b in PHASES) + ")"


@query(sql("SELECT phase, count(*) AS n, round(avg(y), 7) AS mean_y, round(stddev_samp(ret), 9) AS vol FROM regimes JOIN ph ON rn BETWEEN s AND e GROUP BY phase", _PHASE_SQL))
def phase_join(spark, sf_dir):
    ranges = spark.createDataFrame([(n, a, b, 0) for n, a, b in PHASES], "label string, start long, end long, priority int")
    rows = labelled(spark, sf_dir).withColumn("rn", F.row_number().over(f.by(KEY, ORDER)))
    longest = s.returns(spark, sf_dir).groupBy(KEY).count().agg(F.max("count")).first()[0] or 1
    rows = rg.label_ranges(rows, ranges, "rn", out="phase", last=longest).where("phase is not null")
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("y"), 7).alias("mean_y"), rounded(F.stddev_samp("ret")).alias("vol"))


_DETECT = "ch AS (SELECT series_id, rn AS at FROM (SELECT *, lag(regime) OVER (PARTITION BY series_id ORDER BY rn) AS b FROM regimes) WHERE b <> regime), al AS (SELECT series_id, rn AS at FROM regimes WHERE abs(ret) > 0.025)"


def _changes_and_alarms(spark, sf_dir):
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime").withColumn("at", F.row_number().over(f.by(KEY, ORDER)))
    return rows.where("switched").select(KEY, "at"), rows.where(F.abs("ret") > 0.025).select(KEY, "at")


@query(sql("SELECT c.series_id, c.at, min(a.at - c.at) AS lag FROM ch c LEFT JOIN al a ON a.series_id = c.series_id AND a.at >= c.at AND a.at < c.at + 12 GROUP BY ALL", _DETECT))
def detection_lag(spark, sf_dir):
    changes, alarms = _changes_and_alarms(spark, sf_dir)
    return rp.detections(changes, alarms, KEY, "at", 12)


@query(sql("SELECT a.series_id, a.at FROM al a WHERE NOT EXISTS (SELECT 1 FROM ch c WHERE a.series_id = c.series_id AND a.at >= c.at AND a.at < c.at + 12)", _DETECT))
def false_positives(spark, sf_dir):
    changes, alarms = _changes_and_alarms(spark, sf_dir)
    return rp.false_alarms(changes, alarms, KEY, "at", 12)


@query(sql("SELECT count(*) AS n, count(lag) AS hits, round(avg(lag), 9) AS mean_lag, max(lag) AS max_lag FROM (SELECT min(a.at - c.at) AS lag FROM ch c LEFT JOIN al a ON a.series_id = c.series_id AND a.at >= c.at AND a.at < c.at + 12 GROUP BY c.series_id, c.at)", _DETECT))
def detection_summary(spark, sf_dir):
    changes, alarms = _changes_and_alarms(spark, sf_dir)
    found = rp.detections(changes, alarms, KEY, "at", 12)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count("lag").alias("hits"), rounded(F.avg("lag")).alias("mean_lag"), F.max("lag").alias("max_lag"))


@query(sql("""SELECT c.series_id, c.rn AS at, min(x.rn - c.rn) AS lag FROM (SELECT *, lag(regime) OVER (PARTITION BY series_id ORDER BY rn) AS b FROM g) c
  LEFT JOIN g x ON x.series_id = c.series_id AND x.rn >= c.rn AND x.rn < c.rn + 20 AND x.guess = c.regime WHERE c.b <> c.regime GROUP BY ALL""", _GUESS))
def transition_lag(spark, sf_dir):
    rows = f.runs(guessed(spark, sf_dir), KEY, ORDER, "regime").withColumn("at", F.row_number().over(f.by(KEY, ORDER)))
    w = f.by(KEY, ORDER).rowsBetween(0, 19)
    firsts = [F.min(F.when(F.col("guess") == g, F.col("at"))).over(w) for g in range(4)]
    rows = rows.withColumn("first", F.get(F.array(*firsts), F.col("regime")))
    return rows.where("switched").select(KEY, "at", (F.col("first") - F.col("at")).alias("lag"))


@query(sql("""SELECT abs(ret) > 0.03 AS outlier, count(*) AS n, round(avg((guess = regime)::INT), 9) AS accuracy, round(avg(spurious), 9) AS spurious_share, round(avg(steady), 9) AS stable_after FROM (
  SELECT *, (guess <> lag(guess) OVER w AND regime = lag(regime) OVER w)::INT AS spurious, (lead(guess, 5) OVER w = guess)::INT AS steady FROM g WINDOW w AS (PARTITION BY series_id ORDER BY rn)) GROUP BY 1""", _GUESS))
def outlier_stability(spark, sf_dir):
    w = f.by(KEY, ORDER)
    spurious = ((F.col("guess") != F.lag("guess").over(w)) & (F.col("regime") == F.lag("regime").over(w))).cast("int")
    rows = guessed(spark, sf_dir).withColumn("spurious", spurious).withColumn("steady", (F.lead("guess", 5).over(w) == F.col("guess")).cast("int")).withColumn("outlier", F.abs("ret") > 0.03)
    share = F.avg((F.col("guess") == F.col("regime")).cast("int"))
    return rows.groupBy("outlier").agg(F.count(F.lit(1)).alias("n"), rounded(share).alias("accuracy"), rounded(F.avg("spurious")).alias("spurious_share"), rounded(F.avg("steady")).alias("stable_after"))


# Densities and special functions


@query(sql(f"SELECT series_id, seq, round({mixture_sql('y', '-4.5')}, 8) + 0.0 AS logpdf FROM regimes"))
def mixture_logpdf(spark, sf_dir):
    return labelled(spark, sf_dir).select(KEY, "seq", rounded(sp.mixture_logpdf(F.col("y"), -4.5), 8).alias("logpdf"))


@query(sql("SELECT series_id, seq, round(-0.5 * (ln(2 * pi()) + ln(0.0002) + (ret - 0.0001) ** 2 / 0.0002), 8) + 0.0 AS logpdf FROM r"))
def gaussian_logpdf(spark, sf_dir):
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.gaussian_logpdf(F.col("ret"), 0.0001, 0.0002), 8).alias("logpdf"))


@query(sql("SELECT series_id, seq, round(lgamma(3.0) - lgamma(2.5) - 0.5 * ln(5 * pi()) - ln(0.012) - 3.0 * ln(1 + (ret / 0.012) ** 2 / 5), 8) + 0.0 AS logpdf FROM r"))
def student_t_logpdf(spark, sf_dir):
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.student_t_logpdf(F.col("ret"), 0.0, 0.012, 5.0), 8).alias("logpdf"))


@query("SELECT c_custkey, round(lgamma(1 + abs(c_acctbal) / 100.0), 7) AS lg FROM customer")
def lgamma_values(spark, sf_dir):
    from tickweave.runtime import table

    return table(spark, sf_dir, "customer").select("c_custkey", rounded(sp.lgamma(1 + F.abs("c_acctbal") / 100), 7).alias("lg"))


_A = ["(1 + abs(ret) * 100)", "(2 + abs(ret) * 50)", "3.0::DOUBLE"]


@query(sql(f"SELECT series_id, seq, round({' + '.join(f'lgamma({a})' for a in _A)} - lgamma({' + '.join(_A)}), 8) + 0.0 AS log_b FROM r"))
def log_multivariate_beta(spark, sf_dir):
    a = [1 + F.abs("ret") * 100, 2 + F.abs("ret") * 50, F.lit(3.0)]
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.log_multivariate_beta(a), 8).alias("log_b"))


_A0 = f"({' + '.join(_A)})"
_LB = f"({' + '.join(f'lgamma({a})' for a in _A)} - lgamma({_A0}))"
_PSI = [digamma_sql(a) for a in (*_A, _A0)]


@query(sql(f"""SELECT series_id, seq, round({_PSI[0]}, 7) + 0.0 AS psi, round({_LB} + ({_A0} - 3) * {_PSI[3]} - {' - '.join(f'({a} - 1) * {p}' for a, p in zip(_A, _PSI))}, 7) + 0.0 AS entropy,
  round(0 - lgamma(3.0) - {_LB} + {' + '.join(f'({a} - 1) * ({p} - {_PSI[3]})' for a, p in zip(_A, _PSI))}, 7) + 0.0 AS kl FROM r"""))
def dirichlet_entropy(spark, sf_dir):
    a = [1 + F.abs("ret") * 100, 2 + F.abs("ret") * 50, F.lit(3.0)]
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.digamma(a[0]), 7).alias("psi"), rounded(sp.dirichlet_entropy(a), 7).alias("entropy"), rounded(sp.dirichlet_kl(a, [F.lit(1.0)] * 3), 7).alias("kl"))


@query(sql("SELECT series_id, seq, round(sqrt(2) * acosh(1 + ((ret * 100 - 1) ** 2 / 2 + ((0.5 + abs(ret) * 10) - 1.5) ** 2) / (2 * (0.5 + abs(ret) * 10) * 1.5)), 7) AS distance FROM r"))
def fisher_rao_dist(spark, sf_dir):
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.fisher_rao_distance(F.col("ret") * 100, 0.5 + F.abs("ret") * 10, F.lit(1.0), F.lit(1.5)), 7).alias("distance"))


@query(sql("""SELECT series_id, seq, round(sqrt(2) * (c + q * cos(w)), 7) + 0.0 AS mean, round(q * sin(w), 7) AS deviation FROM (
  SELECT *, 2 * atan(exp(ln(tan(atan2(s1, x1 - c) / 2)) * 0.7 + 0.3 * ln(tan(atan2(1.5, x2 - c) / 2)))) AS w FROM (
    SELECT *, sqrt((x1 - c) ** 2 + s1 ** 2) AS q FROM (
      SELECT *, ((x2 ** 2 + 2.25) - (x1 ** 2 + s1 ** 2)) / (2 * (x2 - x1)) AS c FROM (SELECT series_id, seq, ret * 100 / sqrt(2) AS x1, 1 / sqrt(2) AS x2, 0.5 + abs(ret) * 10 AS s1 FROM r))))"""))
def fisher_rao_geodesic(spark, sf_dir):
    m, d = sp.fisher_rao_point(F.col("ret") * 100, 0.5 + F.abs("ret") * 10, F.lit(1.0), F.lit(1.5), 0.3)
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(m, 7).alias("mean"), rounded(d, 7).alias("deviation"))


@query(sql("SELECT series_id, seq, round(exp(-0.1 * rn) * ret * ret * 2, 9) AS e, round((1 + 0.1 * rn) ** -1.5 * (exp(abs(ret)) - 1), 9) AS p, round(0.5 * exp(-0.2 * rn) + 0.5 * exp(-0.05 * rn), 9) AS m FROM r"))
def hawkes_kernel(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("age", F.row_number().over(f.by(KEY, ORDER)))
    x, age = F.abs("ret"), F.col("age")
    return rows.select(KEY, "seq", rounded(sp.hawkes_kernel(age, "exponential", 0.1) * sp.hawkes_mark(x, "quadratic", 2.0)).alias("e"), rounded(sp.hawkes_kernel(age, "power_law", 0.1) * sp.hawkes_mark(x, "exponential")).alias("p"), rounded(sp.hawkes_kernel(age, "sum_exp", 0.1) * sp.hawkes_mark(x, "none")).alias("m"))


@query(sql("SELECT series_id, seq, round(CASE WHEN z < -5 THEN 0 WHEN z > 10 THEN 0.12 ELSE 0.12 / (1 + exp(-2 * (z - 2))) END, 9) AS discount, round(greatest(least(z, 1), -1), 9) + 0.0 AS gradient FROM (SELECT *, ret * 200 AS z FROM r)"))
def sigmoid_discount(spark, sf_dir):
    z = F.col("ret") * 200
    return s.returns(spark, sf_dir).select(KEY, "seq", rounded(sp.sigmoid_discount(z)).alias("discount"), rounded(sp.huber_gradient(z)).alias("gradient"))


@query(sql("SELECT series_id, seq, round(greatest(least(1.5 - 0.5 * age / 12.0, 1), 0.3) * (1 - 1 / (1 + age::DOUBLE)), 9) AS multiplier FROM (SELECT *, row_number() OVER (PARTITION BY series_id, run_id ORDER BY ts, seq) AS age FROM ru)", _RUNS))
def kelly_mult(spark, sf_dir):
    rows = f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime")
    return rows.select(KEY, "seq", rounded(sp.kelly_multiplier(F.col("run_age"), F.lit(12.0), 1 / (1 + F.col("run_age").cast("double")))).alias("multiplier"))


@query(sql("""SELECT series_id, round(CASE WHEN sd < 1e-10 THEN 0.01 ELSE 0.9 * CASE WHEN (q3 - q1) / 1.34 > 1e-10 THEN least(sd, (q3 - q1) / 1.34) ELSE sd END * n ** -0.2 END, 9) AS bandwidth FROM (
  SELECT series_id, count(*) AS n, stddev_pop(y) AS sd, list_sort(list(y))[count(*) // 4 + 1] AS q1, list_sort(list(y))[3 * count(*) // 4 + 1] AS q3 FROM regimes GROUP BY series_id)"""))
def silverman_bw(spark, sf_dir):
    return rp.silverman(labelled(spark, sf_dir), KEY, "y").select(KEY, rounded("bandwidth").alias("bandwidth"))


_LW = "lw AS (SELECT series_id, -abs(ret) * 100 AS lw, 50 * ret AS inc FROM r), lz AS (SELECT series_id, sum(exp(lw)) AS s, sum(exp(2 * lw)) AS q, sum(exp(lw) * lw) AS x, count(*) AS n, sum(exp(lw + inc)) AS z1, sum(exp(lw + inc) * inc) AS zi FROM lw GROUP BY series_id)"


@query(sql("SELECT series_id, round(s * s / q, 7) AS ess, round(ln(s) - x / s, 8) AS entropy, round((ln(s) - x / s) / ln(n), 8) AS norm_entropy, round(ln(s), 8) AS log_sum FROM lz", _LW))
def ess_entropy(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("lw", -F.abs("ret") * 100)
    return rp.weight_summary(rows, KEY, "lw").select(KEY, rounded("ess", 7).alias("ess"), *[rounded(c, 8).alias(c) for c in ("entropy", "norm_entropy", "log_sum")])


@query(sql("SELECT series_id, round(greatest(zi / z1 - ln(z1) + ln(s), 0), 8) AS kl FROM lz", _LW))
def weight_kl(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("lw", -F.abs("ret") * 100).withColumn("inc", 50 * F.col("ret"))
    return rp.weight_kl(rows, KEY, "lw", "inc").select(KEY, rounded("kl", 8).alias("kl"))


@query(sql("SELECT series_id, seq, round(w, 10) AS w FROM (SELECT series_id, seq, exp(-abs(ret) * 100) / sum(exp(-abs(ret) * 100)) OVER (PARTITION BY series_id) AS w FROM r)"))
def lse_norm(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("lw", -F.abs("ret") * 100)
    norm = rp.weight_summary(rows, KEY, "lw").select(KEY, "log_sum")
    return rows.join(norm, KEY).select(KEY, "seq", rounded(F.exp(F.col("lw") - F.col("log_sum")), 10).alias("w"))




def _garch_path(frame, fitted):
    """One-step deviations of each series' own fitted model, as of the tick before."""
    rows = frame.join(fitted.select(KEY, "omega", "alpha", "beta", "mean"), KEY, "left")
    return ordered_fold(rows, KEY, ORDER, ["ret", "omega", "alpha", "beta", "mean"], GarchPath, GarchPath.OUTPUTS, keep=["truth", *MODELS])


class GarchPath:
    """Deviation that a GARCH(1, 1) expects, before a tick is seen; null without parameters."""

    OUTPUTS = "garch double"

    def __init__(self):
        self.v = None

    def step(self, r, omega, alpha, beta, mean):
        if omega is None:
            return (None,)
        if self.v is None:
            self.v = omega / max(1 - alpha - beta, 1e-6)
        out, self.v = math.sqrt(self.v), omega + alpha * (r - mean) ** 2 + beta * self.v
        return (out,)


def compare_models(frame, models, keys=()):
    """Losses of any forecast columns against ``truth``, a row per model (and ``keys``); users add a model by adding its column."""
    long = frame.select(*keys, "truth", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast")) for m in models])).alias("m")).select(*keys, "truth", "m.model", "m.forecast")
    return rp.losses(long, [*keys, "model"], "truth", "forecast")


@query()
def model_compare_garch(spark, sf_dir):
    """All forecasts with each series' own GARCH(1, 1) among them (fitted in sample)."""
    from tickweave.operators import samplers as sm
    from tickweave.operators.fold import ordered_reduce
    from tickweave.runtime import Scratch

    rows = forecasts(spark, sf_dir)
    fitted = ordered_reduce(s.returns(spark, sf_dir), KEY, ORDER, ["ret"], sm.Garch, sm.Garch.OUTPUTS, keyed=True)
    fitted = Scratch(spark, "garch").write(fitted, "fitted")
    return _rounded_losses(compare_models(_garch_path(rows, fitted), [*MODELS, "garch"]), "model")


@query(sql("""SELECT series_id, seq, rn - max(CASE WHEN changed THEN rn END) OVER (PARTITION BY series_id ORDER BY rn) + 1 >= 10 AS stable FROM (
  SELECT *, coalesce(regime <> lag(regime) OVER (PARTITION BY series_id ORDER BY rn), true) AS changed FROM regimes)"""))
def regime_stable(spark, sf_dir):
    """Whether a regime has lasted for ten ticks."""
    return f.runs(labelled(spark, sf_dir), KEY, ORDER, "regime").select(KEY, "seq", (F.col("run_age") >= 10).alias("stable"))
