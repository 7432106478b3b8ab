"""Queries: Monte-Carlo filters, samplers, tuners, synthetic tapes and streams."""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tickweave.operators import features as f
from tickweave.operators import kernels as k
from tickweave.operators import particles as pt
from tickweave.operators import reports as rp
from tickweave.operators import samplers as sm
from tickweave.operators.fold import aligned_fold, blocked_reduce, ordered_fold, ordered_reduce
from tickweave.plans.folds import KEY, ORDER, labelled
from tickweave.plans.registry import ORACLES, query, rounded
from tickweave.plans.reports import _FC, long_forecasts
from tickweave.sources import synthetic
from tickweave.sources import ticks as s
from tickweave.streaming import runner

SHOWN = ["log_vol", "vol", "variance", "ess", "entropy", "surprise", "outlier"]


def filtered(spark, sf_dir, **options):
    return aligned_fold(labelled(spark, sf_dir), KEY, ORDER, ["y"], partial(pt.Bank, **options), pt.Bank.OUTPUTS, keep=["ret"])


def _shown(rows):
    return rows.select(KEY, "seq", *[rounded(c, 8).alias(c) for c in SHOWN], "regime", "resampled")


@query()
def particle_filter(spark, sf_dir):
    return _shown(filtered(spark, sf_dir, n=256))


@query()
def particle_filter_robust(spark, sf_dir):
    return _shown(filtered(spark, sf_dir, n=256, outlier=(0.02, 30.0)))


@query()
def particle_filter_student_t(spark, sf_dir):
    return _shown(filtered(spark, sf_dir, n=256, nu=5.0))


@query()
def particle_filter_moves(spark, sf_dir):
    """With Metropolis moves after resampling, and mutation along the Fisher-Rao geodesic."""
    return _shown(filtered(spark, sf_dir, n=256, outlier=(0.02, 30.0), moves=3, mutation=0.05))


@query()
def extended_step(spark, sf_dir):
    """Excitation, robust tempered update, adaptive forgetting, learning of levels and of transitions, in one pass."""
    rows = aligned_fold(labelled(spark, sf_dir), KEY, ORDER, ["y", "ret"], partial(pt.Extended, n=256, rebuild=20, wait=30), pt.Extended.OUTPUTS)
    shown = ["log_vol", "vol", "ess", "surprise", "outlier", "intensity", "temper", "factor", "stay"]
    return rows.select(KEY, "seq", *[rounded(c, 8).alias(c) for c in shown], "regime", "broke", F.transform("mu", lambda x: F.round(x, 8)).alias("mu"))


@query()
def particle_filter_learning(spark, sf_dir):
    rows = filtered(spark, sf_dir, n=256, outlier=(0.02, 30.0), learn=True)
    return rows.select(KEY, "seq", rounded("log_vol", 8).alias("log_vol"), "regime", F.transform("mu", lambda x: F.round(x, 8)).alias("mu"))


@query()
def particle_filter_lookahead(spark, sf_dir):
    """Ancestors are chosen by the next tick where the last one was surprising."""
    return _shown(filtered(spark, sf_dir, n=256, lookahead=(3.0, 0.5)))


@query()
def multi_model_filter(spark, sf_dir):
    rows = aligned_fold(labelled(spark, sf_dir), KEY, ORDER, ["y", "ret"], partial(pt.MultiModelBank, n=128), pt.MultiModelBank.OUTPUTS)
    return rows.select(KEY, "seq", *[rounded(c, 8).alias(c) for c in ("log_vol", "vol", "vol_std", "ess", "outlier")], F.transform("w", lambda x: F.round(x, 8)).alias("w"), "dominant", "shock")


@query()
def filter_accuracy(spark, sf_dir):
    """Filtered against true log-volatility and regime of the synthetic tape, by scenario."""
    tape = synthetic.scenario_tape(spark, copies=4).withColumn("y", f.log_square(F.col("ret")))
    rows = aligned_fold(tape, "series_id", ["tick"], ["y"], partial(pt.Bank, n=256, outlier=(0.02, 30.0)), pt.Bank.OUTPUTS, keep=["scenario", "true_log_vol", "true_regime"])
    error = F.col("log_vol") - F.col("true_log_vol")
    return rows.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(F.avg(error), 6).alias("bias"),
        F.round(F.corr("log_vol", "true_log_vol"), 6).alias("corr"), F.round(F.avg((F.col("regime") == F.col("true_regime")).cast("int")), 6).alias("accuracy"),
    )


@query()
def fixed_lag_filter(spark, sf_dir):
    rows = filtered(spark, sf_dir, n=128)
    out = f.fixed_lag(rows, KEY, ORDER, "log_vol", 5, "smooth")
    return out.select(KEY, "seq", rounded("smooth", 8).alias("smooth"), "smooth_valid")


def _chains(spark, sf_dir, chains: int):
    """Each series once per chain, so that chains are keys of their own."""
    return labelled(spark, sf_dir).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))


def _windows(rows, sampler, window=sm.WINDOW, **options):
    """Rows of a sampler for the consecutive windows of every series, with the first tick of the window."""
    return ordered_reduce(rows, KEY, ORDER, ["y"], partial(sm.Consecutive, sampler=sampler, window=window, **options), f"first_tick long, {sampler.OUTPUTS}", keyed=True)


@query()
def pmmh_chains(spark, sf_dir):
    rows = blocked_reduce(labelled(spark, sf_dir), KEY, ORDER, "y", partial(sm.PmmhBank, chains=2, particles=256, steps=300, burn=100), sm.PmmhBank.OUTPUTS, width=512)
    names = ["mu", "sigma", "phi", "acceptance", "loglik"]
    return rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("chains"), *[F.round(F.avg(n), 6).alias(n) for n in names], F.round(F.stddev_pop("mu"), 6).alias("between_sd"))


@query()
def pgas_regimes(spark, sf_dir):
    rows = _windows(labelled(spark, sf_dir), sm.Pgas, particles=24)
    return rows.select(KEY, "first_tick", "regime", *[rounded(c, 6).alias(c) for c in ("mu", "sigma", "stay", "share", "kappa", "renewal", "phi")], "sweeps", "stuck")


@query()
def paris_smooth(spark, sf_dir):
    rows = _windows(labelled(spark, sf_dir), sm.Paris, least=5, particles=32, paths=16)
    return rows.select(KEY, "tick", rounded("log_vol", 6).alias("log_vol"), rounded("sd", 6).alias("sd"), "regime", rounded("p_regime", 6).alias("p_regime"), "paths")


@query()
def hdp_states(spark, sf_dir):
    rows = _windows(labelled(spark, sf_dir), sm.StickyHdp, window=2000, sweeps=4)
    return rows.select(KEY, "first_tick", "state", *[rounded(c, 6).alias(c) for c in ("level", "share", "stay", "loglik")], "n_states")


@query()
def hdp_states_blocked(spark, sf_dir):
    rows = _windows(labelled(spark, sf_dir), sm.StickyHdp, window=2000, sweeps=4, blocked=True)
    return rows.select(KEY, "first_tick", "state", *[rounded(c, 6).alias(c) for c in ("level", "share", "stay")], "n_states")


@query()
def pgas_ensemble(spark, sf_dir):
    """Chains of the sampler over whole series: mean and deviation of each regime's level, and whether the chains agree."""
    chains = _chains(spark, sf_dir, 3)
    rows = ordered_reduce(chains, [KEY, "chain"], ORDER, ["y"], partial(sm.Consecutive, sampler=sm.Pgas, particles=24), f"first_tick long, {sm.Pgas.OUTPUTS}", keyed=True)
    out = rows.groupBy(KEY, "first_tick", "regime").agg(F.count(F.lit(1)).alias("chains"), F.avg("mu").alias("mu"), F.stddev_samp("mu").alias("mu_sd"), F.avg("phi").alias("phi"), F.avg("share").alias("share"), F.avg(F.col("sigma") ** 2 / (1 - F.col("phi") ** 2)).alias("within"))
    converged = F.col("mu_sd") < F.greatest(F.lit(0.1), F.sqrt("within"))
    return out.select(KEY, "first_tick", "regime", "chains", *[rounded(c, 6).alias(c) for c in ("mu", "mu_sd", "phi", "share")], converged.alias("converged"))


@query()
def hdp_filter(spark, sf_dir):
    """Regimes found by the sampler, exported to a filter."""
    rows = ordered_reduce(labelled(spark, sf_dir), KEY, ORDER, ["y"], sm.HdpFilter, sm.HdpFilter.OUTPUTS, keyed=True)
    return rows.select(KEY, "first_tick", "n_states", "ticks", rounded("log_vol", 6).alias("log_vol"), rounded("surprise", 6).alias("surprise"))


@query()
def rescued_filter(spark, sf_dir):
    """A filter whose cloud is replaced or mixed by a sampler's when it loses track."""
    rows = ordered_fold(labelled(spark, sf_dir), KEY, ORDER, ["y"], partial(sm.Rescued, period=60, n=48, particles=16), sm.Rescued.OUTPUTS, keyed=True)
    return rows.select(KEY, "seq", rounded("log_vol", 6).alias("log_vol"), rounded("ess", 6).alias("ess"), "trigger", "decision")


@query(f"WITH {s.TICKS_SQL} SELECT series_id, rn - 1 AS i, round(abs(ret) / sum(abs(ret)) OVER (PARTITION BY series_id), 9) AS p FROM r")
def alias_weights(spark, sf_dir):
    """The probabilities that an alias table of each series' absolute returns stands for: the weights' shares."""
    rows = s.returns(spark, sf_dir).withColumn("w", F.abs("ret"))
    return ordered_reduce(rows, KEY, ORDER, ["w"], sm.AliasTable, sm.AliasTable.OUTPUTS).select(KEY, "i", rounded("p").alias("p"))


class _Gate:
    """Live filter at the end of a series against a fresh sampler of its last ticks."""

    OUTPUTS = "decision string, d_mu double, d_h double, kl double"

    def __init__(self, key=()):
        self.filter, self.sampler, self.last = pt.ParticleFilter(key, n=48, regimes=pt.REGIMES[:3], learn=True), sm.Pgas(key, 1, sm.WINDOW, 16), None

    def push(self, y):
        self.last = self.filter.step(y)
        self.sampler.push(y)

    def finish(self):
        rows = self.sampler.finish()
        if not rows:
            return []
        t = [[r[3] if i == j else (1 - r[3]) / 2 for j in range(3)] for i, r in enumerate(rows)]
        live = {"mu": self.last[10], "sigma2": (self.filter.bank.sigma**2).tolist(), "share": self.last[4], "t": self.filter.t.tolist(), "phi": float(1 - self.filter.bank.theta @ self.last[4]), "h": self.last[0], "ess": self.last[5] / 48}
        rescue = {"mu": [r[1] for r in rows], "sigma2": [r[2] ** 2 for r in rows], "share": [r[4] for r in rows], "t": t, "phi": float(sum(r[8] * r[4] for r in rows)), "h": float(sum(r[1] * r[4] for r in rows)), "ess": 0.5}
        decision, d = sm.gate(live, rescue)
        return [(decision, d["mu"], d["h"], d["kl"])]


@query()
def lifeboat_gate(spark, sf_dir):
    rows = ordered_reduce(labelled(spark, sf_dir), KEY, ORDER, ["y"], _Gate, _Gate.OUTPUTS, keyed=True)
    return rows.select(KEY, "decision", *[rounded(c, 6).alias(c) for c in ("d_mu", "d_h", "kl")])


@query()
def garch_fit(spark, sf_dir):
    rows = ordered_reduce(s.returns(spark, sf_dir), KEY, ORDER, ["ret"], sm.Garch, sm.Garch.OUTPUTS, keyed=True)
    return rows.select(KEY, *[rounded(c, 9).alias(c) for c in ("omega", "alpha", "beta")], rounded("loglik", 6).alias("loglik"), "n")


#: Knobs of the filter bank that are tuned, all combinations.
GRID = {"shift": (-0.5, 0.0, 0.5), "scale": (0.7, 1.0, 1.4), "stay": (0.9, 0.97)}


def grid() -> list[tuple[float, float, float]]:
    """All combinations; their number is the product of the lists' lengths."""
    return list(product(*GRID.values()))


def configs():
    return [(tuple((t, m + shift, q * scale) for t, m, q in pt.REGIMES), stay) for shift, scale, stay in grid()]


@query()
def tuner_grid(spark, sf_dir):
    """Scores of all knob combinations over all series; one pass, the combinations are an axis of the kernel."""
    ahead = f.by(KEY, ORDER).rowsBetween(1, 10)
    rows = labelled(spark, sf_dir).withColumn("truth", F.when(F.count("ret").over(ahead) == 10, F.stddev_samp("ret").over(ahead)))
    out = ordered_fold(rows, KEY, ORDER, ["y"], partial(k.HmmBankGrid, configs()), k.HmmBankGrid.OUTPUTS, keep=["truth", "regime"])
    out = out.withColumn("last", F.lag("est").over(f.by(KEY, ORDER)))
    knobs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(GRID, c)]) for c in grid()])
    out = out.select("truth", F.explode(F.arrays_zip(knobs.alias("c"), "est", "last", "log_vol", "loglik")).alias("x"))
    guess = out.select("truth", "x.c.*", "x.est", "x.loglik", F.exp("x.log_vol").alias("vol"), (F.col("x.est") != F.col("x.last")).cast("int").alias("switched"))
    scored = guess.groupBy(*GRID).agg(
        F.sqrt(F.avg((F.col("vol") - F.col("truth")) ** 2)).alias("rmse"), F.corr("vol", "truth").alias("corr"), F.avg(-F.col("loglik")).alias("surprise"),
        F.avg("switched").alias("switch_rate"), F.avg((F.col("est") == 3).cast("int")).alias("crisis_share"),
    )
    score = -F.col("rmse") / 0.01 + F.col("corr") - 0.1 * F.col("surprise") - F.col("switch_rate")
    return scored.select(*GRID, *[F.round(c, 6).alias(c) for c in ("rmse", "corr", "surprise", "switch_rate", "crisis_share")], F.round(score, 6).alias("score"))


#: Knobs of the particle filter that are tuned, all combinations: levels and innovation deviations of calm and (as a ratio)
#: crisis, speeds of reversion likewise, stickiness and forgetting.
KNOBS = {
    "mu_calm": (-5.2, -4.8), "mu_crisis": (-3.6, -3.2), "sigma_calm": (0.08,), "sigma_ratio": (2.0, 4.0),
    "theta_calm": (0.05,), "theta_ratio": (3.0,), "stickiness": (0.92, 0.97), "forgetting": (0.998,),
}
WARM_UP = 10


def knob_options(knobs: dict) -> dict:
    """Options of a filter of four regimes, evenly spaced from calm to crisis."""
    at = [i / 3 for i in range(4)]
    ramp = lambda low, high: [low + (high - low) * x for x in at]
    rows = zip(ramp(knobs["theta_calm"], knobs["theta_calm"] * knobs["theta_ratio"]), ramp(knobs["mu_calm"], knobs["mu_crisis"]), ramp(knobs["sigma_calm"], knobs["sigma_calm"] * knobs["sigma_ratio"]))
    return {"regimes": tuple(rows), "stay": knobs["stickiness"], "forget": knobs["forgetting"], "outlier": (0.02, 30.0)}


def knob_grid(knobs: dict | None = None) -> list[dict]:
    knobs = knobs or KNOBS
    return [dict(zip(knobs, values)) for values in product(*knobs.values())]


class FilterGrid:
    """One bank for every combination of knobs; the outputs are arrays over the combinations."""

    NAMES = {"log_vol": 0, "vol": 1, "est": 3, "ess": 5, "entropy": 6, "surprise": 7, "resampled": 9}
    OUTPUTS = ", ".join(f"{n} array<double>" for n in NAMES)

    def __init__(self, grid, n=64, learn=True):
        self.banks = [pt.Bank(n, learn=learn, **knob_options(g)) for g in grid]

    def add(self, keys):
        return [b.add(keys) for b in self.banks][0]

    def step(self, at, y):
        outs = [b.step(at, y) for b in self.banks]
        return tuple(np.stack([o[i] for o in outs], axis=1).astype(float) for i in self.NAMES.values())


@query()
def tuner_filter(spark, sf_dir):
    """Eleven metrics and the score of all knob combinations of the learning filter, over all series; lower scores are better.

    One pass: the combinations are an axis of the kernel. Metrics leave out each series'
    first ticks; the truth is the deviation of the ten ticks that follow.
    """
    grid, particles = knob_grid(), 64
    w = f.by(KEY, ORDER)
    rows = labelled(spark, sf_dir).withColumn("truth", F.when(F.count("ret").over(w.rowsBetween(1, 10)) == 10, F.stddev_samp("ret").over(w.rowsBetween(1, 10)))).withColumn("rn", F.row_number().over(w))
    out = aligned_fold(rows, KEY, ORDER, ["y"], partial(FilterGrid, grid, particles), FilterGrid.OUTPUTS, keep=["truth", "rn"])
    out = out.withColumn("last", F.lag("est").over(w))
    knobs = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in g.items()]) for g in grid])
    long = out.select("truth", "rn", F.explode(F.arrays_zip(knobs.alias("knobs"), *FilterGrid.NAMES, "last")).alias("x")).where((F.col("rn") > WARM_UP) & (F.col("truth") > 0)).select("truth", "x.*").select("truth", "knobs.*", *FilterGrid.NAMES, "last")
    error, log_error = F.col("vol") - F.col("truth"), F.col("log_vol") - F.log("truth")
    metrics = long.groupBy(*KNOBS).agg(
        F.sqrt(F.avg(error * error)).alias("vol_rmse"), F.avg(F.abs(error)).alias("vol_mae"), F.corr("vol", "truth").alias("vol_corr"), F.sqrt(F.avg(log_error * log_error)).alias("log_vol_rmse"),
        F.avg("surprise").alias("mean_surprise"), F.avg("ess").alias("mean_ess"), F.min("ess").alias("min_ess"), F.avg("resampled").alias("resample_rate"), F.avg("entropy").alias("regime_entropy"),
        F.avg((F.col("est") != F.col("last")).cast("double")).alias("switch_rate"), F.avg((F.col("est") == 3).cast("double")).alias("crisis_fraction"),
    )
    score = 0.4 * F.col("vol_rmse") / 0.02 + 0.25 * F.col("mean_surprise") / 5 + 0.15 * (1 - F.col("vol_corr")) + 0.1 * F.col("switch_rate") * 10 + 0.1 * (1 - F.col("mean_ess") / particles)
    return metrics.select(*KNOBS, *[F.round(c, 5).alias(c) for c in metrics.columns if c not in KNOBS], F.round(score, 5).alias("score"))


@query(f"{_FC} SELECT series_id, arg_min(model, (rmse, model)) AS best, round(min(rmse), 9) AS rmse FROM (SELECT series_id, model, round(sqrt(avg((truth - forecast) ** 2)), 9) AS rmse FROM long WHERE truth IS NOT NULL AND forecast IS NOT NULL GROUP BY ALL) GROUP BY series_id")
def tuner_best(spark, sf_dir):
    rows = rp.losses(long_forecasts(spark, sf_dir), [KEY, "model"], "truth", "forecast").withColumn("rmse", F.round("rmse", 9))
    return rows.groupBy(KEY).agg(F.min_by("model", F.struct("rmse", "model")).alias("best"), F.min("rmse").alias("rmse"))


@query("""SELECT i AS from_state, j AS to_state, round(CASE WHEN i = j THEN 0.94 WHEN abs(i - j) = 1 THEN 0.06 / CASE WHEN i IN (0, 3) THEN 1 ELSE 2 END ELSE 0 END, 9) + 0.0 AS p
  FROM (SELECT unnest(range(4))::INT AS i), (SELECT unnest(range(4))::INT AS j)""")
def transition_builder(spark, sf_dir):
    """Rows that leak only to neighbouring states."""
    i, j = F.col("from_state"), F.col("to_state")
    rows = spark.range(16).select((F.col("id") / 4).cast("int").alias("from_state"), (F.col("id") % 4).cast("int").alias("to_state"))
    near = F.lit(0.06) / F.when(i.isin(0, 3), 1).otherwise(2)
    return rows.withColumn("p", rounded(F.when(i == j, F.lit(0.94)).when(F.abs(i - j) == 1, near).otherwise(F.lit(0.0))))


@query(synthetic.UNIFORM_SQL)
def counter_uniforms(spark, sf_dir):
    """The numbers that synthetic tapes and resampling are made of."""
    return spark.range(2000).select("id", synthetic.uniform(F.lit("tape"), F.col("id")).alias("u"))


@query("""WITH w AS (SELECT c_custkey, abs(c_acctbal) + 1 AS w, sum(abs(c_acctbal) + 1) OVER (ORDER BY c_custkey) AS hi, sum(abs(c_acctbal) + 1) OVER () AS total FROM customer),
  n AS (SELECT *, ceil((hi - w) / total * 500 - 0.37 - 1e-9) AS lo_i, ceil(hi / total * 500 - 0.37 - 1e-9) AS hi_i FROM w)
  SELECT c_custkey, (least(hi_i, 500) - least(lo_i, 500))::BIGINT AS copies FROM n""")
def systematic_resample(spark, sf_dir):
    """How often each weighted row is drawn by one uniform number; counts, without a self-join."""
    from tickweave.operators.resample import systematic_counts
    from tickweave.runtime import table

    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") + 1).alias("w"))
    return systematic_counts(rows, "c_custkey", "w", 500, 0.37).select("c_custkey", "copies")


@query(synthetic.tape_sql())
def synthetic_tape(spark, sf_dir):
    rows = synthetic.scenario_tape(spark)
    return rows.select("tick", "scenario", rounded("true_log_vol", 8).alias("true_log_vol"), "true_regime", rounded("ret").alias("ret"), "is_outlier")


_STREAM_SQL = ORACLES["ewma_vol"].rsplit(") SELECT", 1)[0] + ") SELECT ticks.series_id, ticks.seq, round(v, 9) AS variance, round(sqrt(v), 9) AS vol FROM ticks LEFT JOIN f USING (series_id, seq)"


@query(_STREAM_SQL)
def stream_ewma(spark, sf_dir):
    """The file of events replayed as a stream through the batch kernel."""
    out = runner.replay(spark, sf_dir, ["px"], partial(_PriceEwma), _PriceEwma.OUTPUTS)
    return out.select(KEY, "seq", rounded("variance").alias("variance"), rounded("vol").alias("vol"))


class _PriceEwma(k.Ewma):
    """Volatility of returns made from prices, so that a stream needs no window; nothing before the second price."""

    def __init__(self):
        super().__init__(20)
        self.px = None

    def step(self, px):
        old, self.px = self.px, px
        return super().step(0.01 * float(np.log(px / old))) if old is not None and old > 0 and px > 0 else (None, None)


@query()
def stream_filter(spark, sf_dir):
    out = runner.replay(spark, sf_dir, ["px"], _PriceFilter, _PriceFilter.OUTPUTS, keyed=True)
    return out.select(KEY, "seq", rounded("log_vol", 8).alias("log_vol"), "regime")


class _PriceFilter(pt.ParticleFilter):
    OUTPUTS = "log_vol double, regime int"

    def __init__(self, key):
        super().__init__(key, n=48)
        self.px = None

    def step(self, px):
        old, self.px = self.px, px
        if old is None or old <= 0 or px <= 0:
            return None, None
        out = super().step(k.log_square(0.01 * float(np.log(px / old))))
        return out[0], out[3]
