"""Queries: deterministic state machines over the ticks of every series."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import functions as F

from tickweave.functions.fixed import MIXTURE_MEANS, MIXTURE_VARIANCES, MIXTURE_WEIGHTS
from tickweave.operators import features as f
from tickweave.operators import kernels as k
from tickweave.operators.fold import ordered_fold
from tickweave.plans.registry import ORACLES, query, rounded
from tickweave.sources import ticks as s

KEY, ORDER = "series_id", ["ts", "seq"]
#: Rolling deviations that part the regimes of the labelled ticks.
CUTS = (0.011, 0.0135, 0.017)

Y_SQL = "CASE WHEN abs(ret) < 1e-10 THEN -23.0::DOUBLE ELSE ln(ret * ret) END"
REGIME_SQL = f"""regimes AS (
  SELECT *, {Y_SQL} AS y, CASE WHEN rn < 10 OR vol < {CUTS[0]} THEN 0 WHEN vol < {CUTS[1]} THEN 1 WHEN vol < {CUTS[2]} THEN 2 ELSE 3 END AS regime
  FROM (SELECT *, stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS 9 PRECEDING) AS vol FROM r)
)"""


def labelled(spark, sf_dir):
    """Ticks with y (log square) and the regime of the trailing deviation."""
    rows = f.rolling_std(s.returns(spark, sf_dir), KEY, ORDER, "ret", 10, "vol").withColumn("y", f.log_square(F.col("ret")))
    regime = F.when(F.col("vol").isNull() | (F.col("vol") < CUTS[0]), 0).when(F.col("vol") < CUTS[1], 1).when(F.col("vol") < CUTS[2], 2).otherwise(3)
    return rows.withColumn("regime", regime)


def mixture_sql(y: str, level: str) -> str:
    parts = [f"{w} / sqrt({2 * math.pi * v!r}) * exp(0 - ({y} - 2 * ({level}) - ({m})) ** 2 / {2 * v!r})" for w, m, v in zip(MIXTURE_WEIGHTS, MIXTURE_MEANS, MIXTURE_VARIANCES)]
    return f"ln(({' + '.join(parts)})::DOUBLE)"


def clip_sql(x: str, low, high) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"


def fold_sql(inputs: str, first: str, joined: str, step: str, out: str, more: str = REGIME_SQL) -> str:
    """A recursion over the ticks: ``first`` at a series' first tick, ``step`` from the columns that ``joined`` adds to the state f and the tick t."""
    return f"""WITH RECURSIVE {s.TICKS_SQL}, {more}, t AS MATERIALIZED (SELECT series_id, seq, rn, {inputs} FROM regimes), f AS (
      SELECT series_id, seq, rn, {first} FROM t WHERE rn = 1
      UNION ALL
      SELECT series_id, seq, rn, {step} FROM (SELECT t.series_id, t.seq, t.rn, {joined} FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1) x
    ) SELECT series_id, seq, {out} FROM f"""


def likelihoods(rows, levels):
    """Add ``lik``, the log densities of y at each level."""
    from tickweave.functions.special import mixture_logpdf

    return rows.withColumn("lik", F.array(*[mixture_logpdf(F.col("y"), h) for h in levels]))


def given(rows, inputs, kernel, keep=()):
    """``folded`` for a kernel that is fed with likelihoods."""
    base = kernel.func if isinstance(kernel, partial) else kernel
    options = kernel.keywords if isinstance(kernel, partial) else {}
    return ordered_fold(rows, KEY, ORDER, inputs, partial(k.Given, base, **options), base.OUTPUTS, keep)


def folded(rows, inputs, kernel, keep=()):
    kind = kernel.func if isinstance(kernel, partial) else kernel
    return ordered_fold(rows, KEY, ORDER, inputs, kernel, kind.OUTPUTS, keep)


_A20 = 1 - math.exp(-math.log(2) / 20)


@query(fold_sql("ret", "ret * ret AS v", f"{_A20!r}::DOUBLE * ret * ret + {1 - _A20!r}::DOUBLE * v AS v", "v", "round(v, 9) AS variance, round(sqrt(v), 9) AS vol"))
def ewma_vol(spark, sf_dir):
    return folded(s.returns(spark, sf_dir), ["ret"], partial(k.Ewma, 20)).select(KEY, "seq", rounded("variance").alias("variance"), rounded("vol").alias("vol"))


@query(fold_sql("abs(ret) AS x", "x AS a, x AS b", "0.1::DOUBLE * x + 0.9::DOUBLE * a AS a, 0.01::DOUBLE * x + 0.99::DOUBLE * b AS b", "a, b", "round(a, 9) AS fast, round(b, 9) AS slow, round(CASE WHEN b > 1e-10 THEN a / b ELSE 1 END, 7) AS ratio"))
def ema_ratio(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("x", F.abs("ret"))
    return folded(rows, ["x"], k.EmaRatio).select(KEY, "seq", rounded("fast").alias("fast"), rounded("slow").alias("slow"), rounded("ratio", 7).alias("ratio"))


@query(fold_sql("ret", "ret AS c, abs(ret) AS l", "least(greatest(ret, -2.0 * l), 2.0 * l) AS c, l", "c, 0.05::DOUBLE * abs(c) + 0.95::DOUBLE * l", "round(c, 9) + 0.0 AS clamped, round(l, 9) AS level"))
def running_clamp(spark, sf_dir):
    return folded(s.returns(spark, sf_dir), ["ret"], partial(k.RunningClamp, 2.0)).select(KEY, "seq", rounded("clamped").alias("clamped"), rounded("level").alias("level"))


_UP = math.log(0.99 / 0.01)
_LLR = clip_sql(f"{mixture_sql('y', '-4.0')} - {mixture_sql('y', '-5.0')}", -20, 20)


@query(fold_sql(f"{_LLR} AS d", "d AS q", f"CASE WHEN abs(q) > {_UP!r} THEN 0.0::DOUBLE ELSE q END + d AS q", "q", f"round(q, 8) + 0.0 AS ratio, CASE WHEN q > {_UP!r} THEN 1 WHEN q < -{_UP!r} THEN -1 ELSE 0 END AS decision"))
def sprt_binary(spark, sf_dir):
    rows = likelihoods(labelled(spark, sf_dir), (-5.0, -4.0)).select("*", F.get("lik", F.lit(0)).alias("low"), F.get("lik", F.lit(1)).alias("high"))
    return given(rows, ["low", "high"], k.SprtBinary).select(KEY, "seq", rounded("ratio", 8).alias("ratio"), "decision")


LEVELS4 = ("-6.0", "-5.0", "-4.0", "-3.0")


def _sprt_multi_sql() -> str:
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    ratios = ", ".join(f"r{i}{j}" for i, j in pairs)
    likes = ", ".join(f"{mixture_sql('y', h)} AS l{i}" for i, h in enumerate(LEVELS4))
    moved = ", ".join(f"CASE WHEN abs(v{i}{j}) > {_UP!r} THEN 0.0::DOUBLE ELSE v{i}{j} END AS q{i}{j}" for i, j in pairs)
    added = ", ".join(f"r{i}{j} + {clip_sql(f'l{j} - l{i}', -20, 20)} AS v{i}{j}" for i, j in pairs)
    evidence = ", ".join("(" + " ".join([f"+ q{j}{k}" for j in range(k)] + [f"- q{k}{j}" for j in range(k + 1, 4)]) + f") AS e{k}" for k in range(4))
    total = " + ".join(f"exp(e{k} - top)" for k in range(4))
    shares = ", ".join(f"exp(e{k} - top) / ({total}) AS p{k}" for k in range(4))
    best = "CASE WHEN p0 > greatest(p1, p2, p3, CASE cur WHEN 0 THEN -1 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) THEN 0 WHEN p1 > greatest(p0, p2, p3) THEN 1 WHEN p2 > greatest(p0, p1, p3) THEN 2 WHEN p3 > greatest(p0, p1, p2) THEN 3 ELSE cur END"
    kept = ", ".join(f"CASE WHEN sw AND (b IN ({i}, {j}) OR cur IN ({i}, {j})) AND NOT (least(b, cur) = {i} AND greatest(b, cur) = {j}) THEN 0.0::DOUBLE ELSE q{i}{j} END AS r{i}{j}" for i, j in pairs)
    shown = ", ".join(f"p{k}" for k in range(4))

    def step(source: str) -> str:
        x = f"SELECT *, {added} FROM ({source})"
        x = f"SELECT *, {moved} FROM ({x})"
        x = f"SELECT *, greatest(e0, e1, e2, e3) AS top FROM (SELECT *, {evidence} FROM ({x}))"
        x = f"SELECT *, {shares} FROM ({x})"
        x = f"SELECT *, {best} AS b FROM ({x})"
        x = f"SELECT *, ticks + 1 >= 3 AND b <> cur AND greatest(p0, p1, p2, p3) > 0.7 AS sw FROM ({x})"
        return f"SELECT series_id, seq, rn, CASE WHEN sw THEN b ELSE cur END AS cur, CASE WHEN sw THEN 0 ELSE ticks + 1 END AS ticks, {kept}, {shown} FROM ({x})"

    first = step("SELECT t.*, 0 AS cur, 0 AS ticks, " + ", ".join(f"0.0::DOUBLE AS r{i}{j}" for i, j in pairs) + " FROM t WHERE rn = 1")
    later = step(f"SELECT t.*, f.cur, f.ticks, {ratios} FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1")
    return f"""WITH RECURSIVE {s.TICKS_SQL}, {REGIME_SQL}, t AS MATERIALIZED (SELECT series_id, seq, rn, {likes} FROM regimes), f AS ({first} UNION ALL {later})
      SELECT series_id, seq, cur AS regime, {', '.join(f'round(p{k}, 7) AS p{k}' for k in range(4))} FROM f"""


@query(_sprt_multi_sql())
def sprt_multi(spark, sf_dir):
    out = given(likelihoods(labelled(spark, sf_dir), (-6.0, -5.0, -4.0, -3.0)), ["lik"], k.SprtMulti)
    return out.select(KEY, "seq", "regime", *[rounded(F.get("p", F.lit(i)), 7).alias(f"p{i}") for i in range(4)])


def p2_ctes(source: str, x: str, p: float) -> str:
    """Recursive CTE f of (series_id, seq, rn, x, quantile): five markers as columns, moved one after the other."""
    start, grow = [1 + 2 * p, 1 + 4 * p, 3 + 2 * p], [p / 2, p, (1 + p) / 2]
    state = "w, q0, q1, q2, q3, q4, n1, n2, n3, g1, g2, g3"

    def moved(i: int, rows: str) -> str:
        """Marker i after its move; ends are fixed at 1 and rn."""
        left, right = ("1" if i == 1 else f"n{i - 1}"), ("rn" if i == 3 else f"n{i + 1}")
        rows = f"SELECT *, CASE WHEN g{i} - n{i} >= 1 AND {right} - n{i} > 1 THEN 1 WHEN g{i} - n{i} <= -1 AND {left} - n{i} < -1 THEN -1 ELSE 0 END AS s{i} FROM ({rows})"
        parabola = f"q{i} + s{i} / ({right} - {left})::DOUBLE * ((n{i} - {left} + s{i}) * ((q{i + 1} - q{i}) / ({right} - n{i})) + ({right} - n{i} - s{i}) * ((q{i} - q{i - 1}) / (n{i} - {left})))"
        line = f"CASE WHEN s{i} > 0 THEN q{i} + (q{i + 1} - q{i}) / ({right} - n{i}) ELSE q{i} - (q{i - 1} - q{i}) / ({left} - n{i}) END"
        rows = f"SELECT *, {parabola} AS c{i} FROM ({rows})"
        return f"SELECT * EXCLUDE (s{i}, c{i}) REPLACE (CASE WHEN s{i} = 0 THEN q{i} WHEN q{i - 1} < c{i} AND c{i} < q{i + 1} THEN c{i} ELSE {line} END AS q{i}, n{i} + s{i} AS n{i}) FROM ({rows})"

    joined = f"SELECT t.series_id, t.seq, t.rn, t.x, {state} FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1"
    later = f"SELECT * REPLACE (least(q0, x) AS q0, greatest(q4, x) AS q4), CASE WHEN x < q0 THEN 0 WHEN x >= q4 THEN 3 WHEN x < q1 THEN 0 WHEN x < q2 THEN 1 WHEN x < q3 THEN 2 ELSE 3 END AS cell FROM ({joined} WHERE f.rn >= 5)"
    later = f"SELECT * EXCLUDE (cell) REPLACE (n1 + (cell < 1)::INT AS n1, n2 + (cell < 2)::INT AS n2, n3 + (cell < 3)::INT AS n3, " + ", ".join(f"g{i + 1} + {g!r}::DOUBLE AS g{i + 1}" for i, g in enumerate(grow)) + f") FROM ({later})"
    later = moved(3, moved(2, moved(1, later)))
    first = f"SELECT * REPLACE (list_append(w, x) AS w) FROM ({joined} WHERE f.rn < 5)"
    first = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN rn = 5 THEN list_sort(w)[{i + 1}] ELSE q{i} END AS q{i}" for i in range(5)) + f") FROM ({first})"
    zero = "[x] AS w, " + ", ".join(f"0.0::DOUBLE AS q{i}" for i in range(5)) + ", 2 AS n1, 3 AS n2, 4 AS n3, " + ", ".join(f"{g!r}::DOUBLE AS g{i + 1}" for i, g in enumerate(start))
    return f"""t AS MATERIALIZED (SELECT series_id, seq, rn, {x} AS x FROM {source}), f AS (
      SELECT series_id, seq, rn, x, {zero} FROM t WHERE rn = 1 UNION ALL (({first}) UNION ALL ({later}))
    ), p2 AS (SELECT series_id, seq, rn, x, CASE WHEN rn < 5 THEN x ELSE q2 END AS quantile FROM f)"""


@query(f"WITH RECURSIVE {s.TICKS_SQL}, {p2_ctes('r', 'abs(ret)', 0.9)} SELECT series_id, seq, round(quantile, 9) AS quantile FROM p2")
def p2_quantile(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("x", F.abs("ret"))
    return folded(rows, ["x"], partial(k.P2Quantile, 0.9)).select(KEY, "seq", rounded("quantile").alias("quantile"))


def _forgetting_sql() -> str:
    level = "CASE regime WHEN 0 THEN 0.999 WHEN 1 THEN 0.998 WHEN 2 THEN 0.995 ELSE 0.99 END::DOUBLE"
    inputs = f"-({mixture_sql('y', '-4.5')}) AS sp, CASE WHEN abs(ret) > 0.03 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o, {level} AS lam"

    def step(source: str) -> str:
        x = f"SELECT *, cd = 0 AND z < 1 AS on_, CASE WHEN cd = 0 AND z < 1 THEN 0.01::DOUBLE * sp + 0.99::DOUBLE * base ELSE base END AS nb FROM ({source})"
        x = f"SELECT *, CASE WHEN on_ THEN greatest(0.01, 0.01::DOUBLE * (sp - nb) ** 2 + 0.99::DOUBLE * var) ELSE var END AS nv FROM ({x})"
        x = f"SELECT *, (sp - nb) / (sqrt(nv) + 1e-6::DOUBLE) AS nz FROM ({x})"
        x = f"SELECT *, 0.15::DOUBLE * nz + 0.85::DOUBLE * ema AS ne FROM ({x})"
        x = f"SELECT *, greatest(CASE WHEN ne < -5 THEN 0 WHEN ne > 10 THEN 0.12 ELSE 0.12::DOUBLE / (1 + exp(-2 * (ne - 2))) END, CASE WHEN o > 0.2 THEN 0.12::DOUBLE * least(1, (o - 0.2) / 0.6) ELSE 0 END) AS d FROM ({x})"
        return f"""SELECT series_id, seq, rn, nb AS base, nv AS var, nz AS z, ne AS ema, {clip_sql('CASE WHEN cd > 0 THEN factor ELSE lam * (1 - d) END', 0.98, 0.9995)} AS factor,
          CASE WHEN cd > 0 THEN cd - 1 WHEN d > 0.05 OR nz > 1.5 THEN 10 ELSE 0 END AS cd FROM ({x})"""

    first = step("SELECT t.*, 5.0::DOUBLE AS base, 1.0::DOUBLE AS var, 0.0::DOUBLE AS z, 0.0::DOUBLE AS ema, lam AS factor, 0 AS cd FROM t WHERE rn = 1")
    later = step("SELECT t.*, base, var, z, ema, factor, cd FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1")
    return f"WITH RECURSIVE {s.TICKS_SQL}, {REGIME_SQL}, t AS MATERIALIZED (SELECT series_id, seq, rn, {inputs} FROM regimes), f AS ({first} UNION ALL {later}) SELECT series_id, seq, round(factor, 8) AS factor, round(z, 6) + 0.0 AS z FROM f"


def _surprise(spark, sf_dir):
    from tickweave.functions.special import mixture_logpdf

    return labelled(spark, sf_dir).withColumn("surprise", -mixture_logpdf(F.col("y"), -4.5)).withColumn("outliers", (F.abs("ret") > 0.03).cast("double"))


@query(_forgetting_sql())
def adaptive_forgetting(spark, sf_dir):
    out = folded(_surprise(spark, sf_dir), ["surprise", "outliers", "regime"], partial(k.AdaptiveForgetting, breaker=None))
    return out.select(KEY, "seq", rounded("factor", 8).alias("factor"), rounded("z", 6).alias("z"))


@query()
def forgetting_breaker(spark, sf_dir):
    out = folded(_surprise(spark, sf_dir), ["surprise", "outliers", "regime"], k.AdaptiveForgetting)
    return out.select(KEY, "seq", rounded("factor").alias("factor"), rounded("z", 7).alias("z"), "broke")


@query(fold_sql(
    "(y + 1.27) / 2 AS l", "l, -4.5::DOUBLE AS m, 10.0::DOUBLE AS k, 6.0::DOUBLE AS a, 0.45::DOUBLE AS b",
    "t.l, 0.1::DOUBLE AS w, t.l - 0.9::DOUBLE * f.l AS z, m, greatest(0.995 * k, 5.0::DOUBLE) AS kd, 3 + 0.995::DOUBLE * greatest(a - 3, 0) AS ad, 0.995::DOUBLE * b AS bd",
    "l, (kd * m + z * 0.1::DOUBLE) / (kd + 0.01::DOUBLE), kd + 0.01::DOUBLE, ad + 0.5, bd + 0.5::DOUBLE * (z / 0.1::DOUBLE - m) ** 2 / (1 / kd + 100.0::DOUBLE)",
    "round(m, 7) AS mu, round(sqrt(b / (a - 1)), 7) AS sigma, round(k, 7) AS kappa",
))
def nig_update(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("l", (F.col("y") + 1.27) / 2)
    return folded(rows, ["l"], k.Nig).select(KEY, "seq", rounded("mu", 7).alias("mu"), rounded("sigma", 7).alias("sigma"), rounded("kappa", 7).alias("kappa"))


@query(fold_sql(
    "(y + 1.27) / 2 AS l", "l, 0.0::DOUBLE AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q", "t.l, t.l - 0.9::DOUBLE * f.l AS z, n, s, q",
    "l, 0.999::DOUBLE * n + 1, 0.999::DOUBLE * s + z, 0.999::DOUBLE * q + z * z",
    "round(CASE WHEN n < 20 THEN -4.5 ELSE s / n / 0.1::DOUBLE END, 7) AS mu, round(CASE WHEN n < 20 THEN 0.3 ELSE sqrt(greatest(1e-10, q / n - (s / n) ** 2)) END, 7) AS sigma, round(n, 7) AS n_eff",
))
def ewss_update(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("l", (F.col("y") + 1.27) / 2)
    return folded(rows, ["l"], k.Ewss).select(KEY, "seq", rounded("mu", 7).alias("mu"), rounded("sigma", 7).alias("sigma"), rounded("n_eff", 7).alias("n_eff"))


def _dirichlet_event_sql() -> str:
    prior = k.geometric_prior((-6.0, -5.0, -4.0, -3.0))
    cells = [(i, j) for i in range(4) for j in range(4)]
    start = ", ".join(f"{prior[i][j]!r}::DOUBLE AS a{i}{j}" for i, j in cells)
    moved = ", ".join(f"CASE WHEN was = {i} AND was <> regime THEN greatest(0.01, 0.999::DOUBLE * a{i}{j}) + CASE WHEN regime = {j} THEN 1 ELSE 0 END ELSE a{i}{j} END AS a{i}{j}" for i, j in cells)
    row = lambda j: "CASE regime " + " ".join(f"WHEN {i} THEN a{i}{j} / (a{i}0 + a{i}1 + a{i}2 + a{i}3)" for i in range(4)) + " END"
    return fold_sql("regime", f"regime, {start}", f"t.regime, f.regime AS was, {', '.join(f'a{i}{j}' for i, j in cells)}", f"regime, {moved}", f"regime, {', '.join(f'round({row(j)}, 8) AS p{j}' for j in range(4))}")


@query(_dirichlet_event_sql())
def dirichlet_event(spark, sf_dir):
    out = folded(labelled(spark, sf_dir), ["regime"], k.DirichletEvent, keep=["regime"])
    return out.select(KEY, "seq", "regime", *[rounded(F.get("p", F.lit(j)), 8).alias(f"p{j}") for j in range(4)])


LEVELS3 = ("-6.0", "-5.0", "-4.0")
_N3 = range(3)


def _transition_sql(gain: str, learnt: str, before: str, first_alpha, out: str, more: str = "") -> str:
    """A recursion over regime probabilities p and row weights a: joint weights x come from ``gain`` (a factor of i and j),
    new row weights from ``learnt``, columns computed before that from ``before``."""
    alphas = ", ".join(f"a{i}{j}" for i in _N3 for j in _N3)
    likes = ", ".join(f"{mixture_sql('y', h)} AS l{i}" for i, h in enumerate(LEVELS3))
    raw = ", ".join(f"p{i} * {gain.format(i=i, j=j, row=' + '.join(f'a{i}{q}' for q in _N3))} * exp(l{j} - top) AS u{i}{j}" for i in _N3 for j in _N3)
    total = " + ".join(f"u{i}{j}" for i in _N3 for j in _N3)
    joint = ", ".join(f"u{i}{j} / ({total}) AS x{i}{j}" for i in _N3 for j in _N3)
    new_p = ", ".join(f"{' + '.join(f'x{i}{j}' for i in _N3)} AS n{j}" for j in _N3)
    new_a = ", ".join(f"{learnt.format(i=i, j=j)} AS b{i}{j}" for i in _N3 for j in _N3)
    x = f"SELECT t.*, n, p0, p1, p2, {alphas} FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1"
    x = f"SELECT *, {raw} FROM ({x})"
    x = f"SELECT *, {joint} FROM ({x})"
    x = f"SELECT *, {new_p} FROM ({x})"
    x = f"SELECT *, {before} FROM ({x})"
    x = f"SELECT *, {new_a} FROM ({x})"
    x = f"SELECT *, {', '.join(f'{chr(32)}+ '.join(f'b{i}{j}' for j in _N3) + f' AS s{i}' for i in _N3)} FROM ({x})"
    final = ", ".join((f"CASE WHEN s{i} > 100 THEN greatest(0.01, b{i}{j} * 100 / s{i}) ELSE b{i}{j} END" if more else f"b{i}{j}") + f" AS a{i}{j}" for i in _N3 for j in _N3)
    start_p = ", ".join(f"exp(l{j} - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)) AS p{j}" for j in _N3)
    start_a = ", ".join(f"{first_alpha(i, j)!r}::DOUBLE AS a{i}{j}" for i in _N3 for j in _N3)
    return f"""WITH RECURSIVE {s.TICKS_SQL}, {REGIME_SQL}, t AS MATERIALIZED (SELECT *, greatest(l0, l1, l2) AS top FROM (SELECT series_id, seq, rn, {likes} FROM regimes)),
      f AS (SELECT series_id, seq, rn, 0 AS n, {start_p}, {start_a}, 0.0::DOUBLE AS rate FROM t WHERE rn = 1
        UNION ALL SELECT series_id, seq, rn, n + 1, n0, n1, n2, {final}, rate FROM ({x}))
      SELECT series_id, seq, {', '.join(f'round(a{i}{i} / (a{i}0 + a{i}1 + a{i}2), 7) AS stay{i}' for i in _N3)}, {out} FROM f"""


_ENTROPY = " + ".join(f"CASE WHEN {{v}}{j} > 1e-10 THEN -{{v}}{j} * ln({{v}}{j}) ELSE 0 END" for j in _N3)


def _stays(out):
    return [rounded(F.get("stay", F.lit(i)), 7).alias(f"stay{i}") for i in _N3]


@query(_transition_sql(
    "a{i}{j} / ({row})", "greatest(0.01::DOUBLE, g * a{i}{j} + x{i}{j})", f"{clip_sql(f'0.999::DOUBLE - 0.01::DOUBLE * ({_ENTROPY.format(v=chr(110))})', 0.95, 0.9995)} AS g, 0.0::DOUBLE AS rate",
    lambda i, j: 100 / 3, f"round({_ENTROPY.format(v=chr(112))}, 7) + 0.0 AS entropy", more="cap",
))
def soft_dirichlet(spark, sf_dir):
    out = given(likelihoods(labelled(spark, sf_dir), (-6.0, -5.0, -4.0)), ["lik"], partial(k.SoftDirichlet, gamma=0.999, adapt=0.01))
    return out.select(KEY, "seq", *_stays(out), rounded("entropy", 7).alias("entropy"))


def digamma_sql(x: str) -> str:
    z = f"({x} + 6)"
    low = " + ".join(f"1 / ({x} + {i})" for i in range(6))
    return f"(ln({z}) - 0.5 / {z} - 1 / {z} ** 2 * (1 / 12.0 - 1 / {z} ** 2 * (1 / 120.0 - 1 / {z} ** 2 * (1 / 252.0 - 1 / {z} ** 2 * (1 / 240.0 - 1 / {z} ** 2 / 132)))) - ({low}))"


@query(_transition_sql(
    f"exp({digamma_sql('a{i}{j}')} - {digamma_sql('({row})')})", "greatest(1e-6, (1 - rate) * a{i}{j} + rate * (CASE WHEN {i} = {j} THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END + x{i}{j}))",
    f"{clip_sql('(64 + n + 1)::DOUBLE ** -0.7', 0.001, 1)} AS rate", lambda i, j: 6.0 if i == j else 1.0, "round(rate, 8) AS rate",
))
def online_vi(spark, sf_dir):
    out = given(likelihoods(labelled(spark, sf_dir), (-6.0, -5.0, -4.0)), ["lik"], k.OnlineVi)
    return out.select(KEY, "seq", *_stays(out), rounded("rate", 8).alias("rate"))


_SCALE = "CASE regime WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"
_JUMP = "CASE WHEN abs(ret) > 0.02 THEN 0.3::DOUBLE * least(abs(ret) / 0.02::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END"


@query(fold_sql(
    f"{_SCALE} AS c, {_JUMP} AS j", "0.05::DOUBLE + j AS i, j > 0 AS e", "0.05::DOUBLE + (i - 0.05::DOUBLE) * exp(-0.1::DOUBLE * c) + j AS i, j > 0 AS e", "i, e", "round(i, 8) AS intensity, e AS event",
))
def hawkes_intensity(spark, sf_dir):
    return folded(labelled(spark, sf_dir), ["ret", "regime"], partial(k.Hawkes, threshold=0.02)).select(KEY, "seq", rounded("intensity", 8).alias("intensity"), "event")


class _Boosted(k.Hawkes):
    """Transition row of the present regime under the present intensity."""

    OUTPUTS = "intensity double, row array<double>"
    ROWS = [[0.95 if i == j else 0.05 / 3 for j in range(4)] for i in range(4)]

    def step(self, r, regime):
        now, _ = super().step(r, regime)
        return now, k.hawkes_boost(self.ROWS, now)[regime]


def _boost_sql() -> str:
    row = "0.95::DOUBLE", f"{0.05 / 3!r}::DOUBLE"
    cell = lambda i, j: row[0] if i == j else row[1]
    taken = lambda i, j: f"greatest(least({cell(i, j)} * g, {cell(i, j)} - 0.02), 0)"
    columns = []
    for j in range(4):
        rows = []
        for i in range(4):
            up = 3 - i
            if not up:
                rows.append(cell(i, j))
            elif j <= i:
                rows.append(f"{cell(i, j)} - {taken(i, j)}")
            else:
                rows.append(f"{cell(i, j)} + ({' + '.join(taken(i, q) for q in range(i + 1))}) * {j - i} / {sum(range(1, up + 1))}")
        columns.append("round(CASE regime " + " ".join(f"WHEN {i} THEN CASE WHEN g IS NULL THEN {cell(i, j)} ELSE {x} END" for i, x in enumerate(rows)) + f" END, 8) AS p{j}")
    base = ORACLES["hawkes_intensity"].replace("round(i, 8) AS intensity, e AS event", "i")
    head, tail = base.rsplit(") SELECT", 1)
    return f"""{head}), h AS (SELECT {tail}), b AS (SELECT h.series_id, h.seq, regime, i, CASE WHEN i - 0.05 >= 0.005 THEN least(0.1 * (i - 0.05), 0.25) END AS g FROM h JOIN regimes USING (series_id, seq))
      SELECT series_id, seq, round(i, 8) AS intensity, {', '.join(columns)} FROM b"""


@query(_boost_sql())
def hawkes_boost(spark, sf_dir):
    out = folded(labelled(spark, sf_dir), ["ret", "regime"], partial(_Boosted, threshold=0.02))
    return out.select(KEY, "seq", rounded("intensity", 8).alias("intensity"), *[rounded(F.get("row", F.lit(j)), 8).alias(f"p{j}") for j in range(4)])


def _hawkes_history_sql() -> str:
    """Sums over the events before, by a self-join; the average is a fold of the list so far."""
    pick = lambda i: "CASE regime " + " ".join(f"WHEN {j} THEN {row[i]!r}::DOUBLE" for j, row in enumerate(k.HawkesEngine.ladder())) + " END"
    excited = lambda later: f"least(greatest(base + coalesce(sum(e.a * exp(-e.b * (t.rn + {later} - e.rn))) FILTER (e.number > t.events - 128), 0), 0.001::DOUBLE), 5.0::DOUBLE)"
    return f"""WITH {s.TICKS_SQL}, {REGIME_SQL}, t AS (SELECT *, sum(hit::INT) OVER (PARTITION BY series_id ORDER BY rn) AS events FROM (
        SELECT series_id, seq, rn, {pick(0)} AS base, {pick(1)} * {pick(4)} * abs(ret) AS a, {pick(2)} AS b, abs(ret) > {pick(3)} * 0.5 AS hit FROM regimes)),
      e AS (SELECT series_id, rn, a, b, events AS number FROM t WHERE hit),
      i AS (SELECT t.series_id, t.seq, t.rn, {excited(0)} AS now, least(any_value(t.events), 128)::INT AS n_events, {excited(10)} AS ahead
            FROM t LEFT JOIN e ON e.series_id = t.series_id AND e.rn <= t.rn GROUP BY t.series_id, t.seq, t.rn, t.base, t.events),
      l AS (SELECT *, list(now) OVER (PARTITION BY series_id ORDER BY rn) AS before FROM i)
      SELECT series_id, seq, round(now, 9) AS intensity, round(list_reduce(before, lambda a, x: 0.05::DOUBLE * x + 0.95::DOUBLE * a), 9) AS average, n_events, round(ahead, 9) AS ahead FROM l"""


@query(_hawkes_history_sql())
def hawkes_history(spark, sf_dir):
    return folded(labelled(spark, sf_dir), ["ret", "regime"], partial(k.HawkesEngine, scale=0.5)).select(KEY, "seq", rounded("intensity").alias("intensity"), rounded("average").alias("average"), "n_events", rounded("ahead").alias("ahead"))


@query(f"""WITH {s.TICKS_SQL}, e AS (SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts, seq)) AS gap FROM r WHERE abs(ret) > 0.01),
  g AS (SELECT series_id, count(gap) AS n, avg(gap) / 3600 AS m, var_samp(gap) / 12960000 AS v FROM e GROUP BY series_id)
  SELECT series_id, n + 1 AS n_events, round(CASE WHEN n < 10 THEN 0.05 ELSE least(greatest((1 - {clip_sql('(v / m ** 2 - 1) / (v / m ** 2 + 1)', 0.1, 0.9)}) / m, 0.01), 0.5) END, 8) AS mu,
    round(CASE WHEN n < 10 THEN 0.5 ELSE {clip_sql('(v / m ** 2 - 1) / (v / m ** 2 + 1)', 0.1, 0.9)} END, 8) AS branching,
    round(CASE WHEN n < 10 THEN 0.1 ELSE least(greatest(0.693 / (2 * m), 0.02), 0.5) END, 8) AS beta FROM g""")
def hawkes_moments(spark, sf_dir):
    from tickweave.operators.reports import hawkes_moments as moments

    events = s.returns(spark, sf_dir).where(F.abs("ret") > 0.01)
    out = moments(events, KEY, ORDER, F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9), least=10)
    return out.select(KEY, "n_events", *[rounded(c, 8).alias(c) for c in ("mu", "branching", "beta")])


def _bocpd_sql(hazard: str, out: str) -> str:
    """Run-length recursion with lists as state; ``hazard`` is an expression of the run i (from 0) and of the decayed counts of changes and ticks, ch and se."""
    density = (
        "exp(lgamma(a[i + 1] + 0.5) - lgamma(a[i + 1]) - 0.5 * ln(2 * a[i + 1] * pi() * (b[i + 1] * (k[i + 1] + 1) / (a[i + 1] * k[i + 1])))"
        " - (a[i + 1] + 0.5) * ln(1 + (ret - m[i + 1]) ** 2 / (2 * a[i + 1] * (b[i + 1] * (k[i + 1] + 1) / (a[i + 1] * k[i + 1])))))"
    )
    x = "SELECT t.*, r, m, k, a, b, mass, dk, dm, da, db, ch, se FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1"
    x = f"SELECT *, list_transform(range(len(r)), lambda i: r[i + 1] * {density}) AS j FROM ({x})"
    x = f"SELECT *, list_concat([list_sum(list_transform(range(len(j)), lambda i: j[i + 1] * {hazard}))], list_transform(range(len(j)), lambda i: j[i + 1] * (1 - {hazard}))) AS u FROM ({x})"
    x = f"SELECT *, list_transform(u, lambda v: v / list_sum(u)) AS w FROM ({x})"
    x = f"SELECT *, list_max(list_transform(range(len(w)), lambda i: CASE WHEN w[i + 1] > 1e-6 THEN i + 1 ELSE 1 END)) AS last FROM ({x})"
    x = f"SELECT *, list_transform(w[1:last], lambda v: v / list_sum(w[1:last])) AS nr FROM ({x})"
    x = f"""SELECT series_id, seq, rn, nr AS r, list_concat([0.0::DOUBLE], list_transform(range(len(m)), lambda i: (k[i + 1] * m[i + 1] + ret) / (k[i + 1] + 1)))[1:last] AS m,
      list_concat([1.0::DOUBLE], list_transform(k, lambda v: v + 1))[1:last] AS k, list_concat([1.0::DOUBLE], list_transform(a, lambda v: v + 0.5))[1:last] AS a,
      list_concat([1e-4::DOUBLE], list_transform(range(len(b)), lambda i: b[i + 1] + 0.5 * k[i + 1] * (ret - m[i + 1]) ** 2 / (k[i + 1] + 1)))[1:last] AS b,
      list_sum(nr[1:15]) AS mass, list_sum(nr[1:15]) - mass AS d, dk, dm, da, db, 0.999::DOUBLE * ch + nr[1] AS ch, 0.999::DOUBLE * se + 1 AS se FROM ({x})"""
    x = f"SELECT *, (d - dm) / sqrt(greatest(db / da, 1e-6)) AS z, (0.99::DOUBLE * dk * dm + d) / (0.99::DOUBLE * dk + 1) AS nm FROM ({x})"
    x = f"SELECT series_id, seq, rn, r, m, k, a, b, mass, 0.99::DOUBLE * dk + 1, nm, 0.99::DOUBLE * da + 0.5, 0.99::DOUBLE * db + 0.5 * (d - dm) * (d - nm), z, ch, se FROM ({x})"
    first = """SELECT series_id, seq, rn, [1.0::DOUBLE] AS r, [ret / 2] AS m, [2.0::DOUBLE] AS k, [1.5::DOUBLE] AS a, [1e-4::DOUBLE + 0.5 * ret ** 2 / 2] AS b, 1.0::DOUBLE AS mass,
      1.0::DOUBLE AS dk, 0.0::DOUBLE AS dm, 1.0::DOUBLE AS da, 0.01::DOUBLE AS db, 0.0::DOUBLE AS z, 0.0::DOUBLE AS ch, 0.0::DOUBLE AS se FROM t WHERE rn = 1"""
    return f"WITH RECURSIVE {s.TICKS_SQL}, t AS MATERIALIZED (SELECT series_id, seq, rn, ret FROM r), f AS ({first} UNION ALL {x}) SELECT series_id, seq, {out} FROM f"


@query(_bocpd_sql("0.01::DOUBLE", "list_position(r, list_max(r)) - 1 AS map_run, round(list_sum(r[1:5]), 7) AS p_change, len(r) AS n_runs"))
def bocpd_runlength(spark, sf_dir):
    return folded(s.returns(spark, sf_dir), ["ret"], k.Bocpd).select(KEY, "seq", "map_run", rounded("p_change", 7).alias("p_change"), "n_runs")


@query(_bocpd_sql("least(1.0::DOUBLE, 0.8::DOUBLE / (i + 1))", "round(mass, 7) AS short_mass, round(z, 5) + 0.0 AS delta_z, abs(z) > 3 AS alarm"))
def bocpd_delta(spark, sf_dir):
    out = folded(s.returns(spark, sf_dir), ["ret"], partial(k.Bocpd, ("power", 0.8)))
    return out.select(KEY, "seq", rounded("short_mass", 7).alias("short_mass"), rounded("delta_z", 5).alias("delta_z"), (F.abs("delta_z") > 3).alias("alarm"))


@query(_bocpd_sql("((1 + ch) / (101 + se))", "list_position(r, list_max(r)) - 1 AS map_run, round(list_sum(r[1:5]), 7) AS p_change"))
def bocpd_learned_hazard(spark, sf_dir):
    return folded(s.returns(spark, sf_dir), ["ret"], partial(k.Bocpd, ("learned", 1.0, 100.0, 0.999))).select(KEY, "seq", "map_run", rounded("p_change", 7).alias("p_change"))


_L = [mixture_sql("y", h) for h in ("-5.0", "-4.5", "-3.8")]


def _imm_sql() -> str:
    state = "w0, w1, w2, lv"
    signal = "greatest(o, least(greatest((lv + 4) / 2, 0.0::DOUBLE), 1.0::DOUBLE))"
    rows = f"SELECT *, 0.98::DOUBLE - (0.98::DOUBLE - 0.85::DOUBLE) * sg AS k, 1 + 0.5::DOUBLE * sg AS e FROM (SELECT *, {signal} AS sg FROM (SELECT t.*, {state} FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1))"

    def entry(i, j):
        stay = "k" if i != 2 else "(k * 0.92::DOUBLE)"
        part = lambda q: stay if q == i else f"((1 - {stay}) / 2)" + (" * e" if q == 2 and i != 2 else "")
        return f"(({part(j)}) / ({' + '.join(part(q) for q in range(3))}) * 100 + 1) / 103"

    c = ", ".join(f"greatest(1e-6, {' + '.join(f'w{i} * {entry(i, j)}' for i in range(3))}) * exp(l{j}) AS u{j}" for j in range(3))
    w = ", ".join(f"u{j} / (u0 + u1 + u2) AS w{j}" for j in range(3))
    lv = "w0 * -5.0::DOUBLE + w1 * -4.5::DOUBLE + w2 * -3.8::DOUBLE"
    step = f"SELECT series_id, seq, rn, w0, w1, w2, {lv} AS lv FROM (SELECT series_id, seq, rn, {w} FROM (SELECT series_id, seq, rn, {c} FROM ({rows})))"
    first = step.replace("FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1", "FROM t, (SELECT 1.0::DOUBLE / 3 AS w0, 1.0::DOUBLE / 3 AS w1, 1.0::DOUBLE / 3 AS w2, -4.5::DOUBLE AS lv) WHERE rn = 1")
    likes = ", ".join(f"{x} AS l{j}" for j, x in enumerate(_L))
    mean = "(w0 * exp(-5.0) + w1 * exp(-4.5) + w2 * exp(-3.8))"
    between = f"w0 * (exp(-5.0) - {mean}) ** 2 + w1 * (exp(-4.5) - {mean}) ** 2 + w2 * (exp(-3.8) - {mean}) ** 2"
    within = "w0 * (exp(-5.0) * 0.25) ** 2 + w1 * (exp(-4.5) * 0.35) ** 2 + w2 * (exp(-3.8) * 0.5) ** 2"
    return f"""WITH RECURSIVE {s.TICKS_SQL}, {REGIME_SQL}, t AS MATERIALIZED (SELECT series_id, seq, rn, CASE WHEN abs(ret) > 0.03 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o, {likes} FROM regimes),
      f AS ({first} UNION ALL {step})
      SELECT series_id, seq, round(w0, 7) AS w_calm, round(w1, 7) AS w_trend, round(w2, 7) AS w_crisis, round(lv, 7) AS log_vol, round(sqrt({between} + {within}), 8) AS total_std FROM f"""


def _imm(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("o", (F.abs("ret") > 0.03).cast("double"))
    return given(likelihoods(rows, (-5.0, -4.5, -3.8)), ["lik", "o"], k.Imm, keep=["y"])


@query(_imm_sql())
def imm_weights(spark, sf_dir):
    w = [rounded(F.get("w", F.lit(i)), 7).alias(f"w_{n}") for i, n in enumerate(("calm", "trend", "crisis"))]
    return _imm(spark, sf_dir).select(KEY, "seq", *w, rounded("log_vol", 7).alias("log_vol"), rounded("total_std", 8).alias("total_std"))


def _em_sql() -> str:
    g = [clip_sql(f"y - (b + ({c}) * s)", -1, 1) for c in ("-1.0", "0.0", "1.5")]
    sums = f"({g[0]} + {g[1]} + {g[2]}) / 3 AS gb, (-({g[0]}) + 1.5::DOUBLE * {g[2]}) / 3 AS gs"
    return fold_sql(
        "y", "-4.5::DOUBLE AS b, 1.0::DOUBLE AS s", f"t.rn AS n, b, s, {sums}",
        f"CASE WHEN n > 20 THEN {clip_sql('b + 0.01::DOUBLE * gb', -9, 2)} ELSE b END, CASE WHEN n > 20 THEN {clip_sql('s + CASE WHEN gs > 0 THEN 0.05::DOUBLE ELSE 0.001::DOUBLE END * gs', 0.5, 4)} ELSE s END",
        "round(b, 8) AS base, round(s, 8) AS spread",
    )


@query(_em_sql())
def online_em(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("w", F.array(*[F.lit(1 / 3)] * 3))
    return folded(rows, ["y", "w"], partial(k.OnlineEm, wait=20)).select(KEY, "seq", rounded("base", 8).alias("base"), rounded("spread", 8).alias("spread"))


@query(fold_sql(
    "abs(ret) * 50 AS h, abs(ret) > 0.03 AS shock", "h, shock AS locked, 0 AS n, CASE WHEN shock THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ema",
    "t.h, t.shock, f.locked, f.n + 1 AS n, f.ema AS before, 0.3::DOUBLE * abs(t.h - f.h) + 0.7::DOUBLE * f.ema AS after",
    "h, CASE WHEN shock THEN true WHEN locked THEN NOT (n >= 50 OR n >= 3 AND after < 0.5::DOUBLE * greatest(h, 0.01)) ELSE false END, CASE WHEN shock THEN 0 ELSE n END, CASE WHEN shock THEN 1.0::DOUBLE WHEN locked THEN after ELSE before END",
    "locked, round(ema, 8) AS change",
))
def entropy_lock(spark, sf_dir):
    rows = s.returns(spark, sf_dir).select("*", (F.abs("ret") * 50).alias("h"), (F.abs("ret") > 0.03).alias("shock"))
    return folded(rows, ["h", "shock"], partial(k.EntropyLock, share=0.5)).select(KEY, "seq", "locked", rounded("change", 8).alias("change"))


_STAY = clip_sql("1 - (1 - (1 + kp) / (4 + kp)) * ch", 0.5, 0.999)


@query(fold_sql(
    "abs(ret) * 60 AS x", "1 + 1 / 1.97::DOUBLE * (x - 1) AS th, least(greatest((1 - 1 / 1.97::DOUBLE) / 0.97::DOUBLE, 0.01), 10) AS p, exp(0.8::DOUBLE * ln(50) + 0.2::DOUBLE * ln(greatest((STAY * 4 - 1) / (1 - STAY), 1e-3))) AS kp".replace("STAY", _STAY.replace("kp", "50.0::DOUBLE").replace("ch", clip_sql("1 + 1 / 1.97::DOUBLE * (x - 1)", 0.3, 3))),
    "th + p / (0.97::DOUBLE + p) * (x - th) AS th, least(greatest((p - p / (0.97::DOUBLE + p) * p) / 0.97::DOUBLE, 0.01), 10) AS p, kp",
    "th, p, exp(0.8::DOUBLE * ln(kp) + 0.2::DOUBLE * ln(greatest((STAY * 4 - 1) / (1 - STAY), 1e-3)))".replace("STAY", _STAY.replace("ch", clip_sql("th", 0.3, 3))),
    f"round({clip_sql('th', 0.3, 3)}, 8) AS chatter, round(kp, 6) AS kappa",
))
def rls_kappa(spark, sf_dir):
    rows = s.returns(spark, sf_dir).withColumn("x", F.abs("ret") * 60)
    return folded(rows, ["x"], k.RlsKappa).select(KEY, "seq", rounded("chatter", 8).alias("chatter"), rounded("kappa", 6).alias("kappa"))


def _bank(spark, sf_dir):
    return folded(labelled(spark, sf_dir), ["y"], k.HmmBank, keep=["y", "ret", "vol"]).withColumnRenamed("regime", "est_regime")


def _bank_sql() -> str:
    from tickweave.operators.particles import REGIMES

    n = range(4)
    t = lambda i, j: "0.95::DOUBLE" if i == j else f"{0.05 / 3!r}::DOUBLE"
    w, m, v = (f"[{', '.join(f'{x!r}::DOUBLE' for x in xs)}]" for xs in (MIXTURE_WEIGHTS, MIXTURE_MEANS, MIXTURE_VARIANCES))
    state = ", ".join(f"p{i}, m{i}, v{i}" for i in n)

    def step(source: str) -> str:
        x = f"SELECT *, {', '.join(' + '.join(f'p{i} * {t(i, j)}' for i in n) + f' AS c{j}' for j in n)} FROM ({source})"
        x = f"SELECT *, {', '.join('(' + ' + '.join(f'p{i} * {t(i, j)} * m{i}' for i in n) + f') / c{j} AS d{j}' for j in n)} FROM ({x})"
        x = f"SELECT *, {', '.join('(' + ' + '.join(f'p{i} * {t(i, j)} * (v{i} + (m{i} - d{j}) ** 2)' for i in n) + f') / c{j} AS e{j}' for j in n)} FROM ({x})"
        x = f"SELECT *, {', '.join(f'{1 - th!r}::DOUBLE * d{j} + {th * mu!r}::DOUBLE AS g{j}, {(1 - th) ** 2!r}::DOUBLE * e{j} + {q * q!r}::DOUBLE AS h{j}' for j, (th, mu, q) in enumerate(REGIMES))} FROM ({x})"
        part = "kw[c] / sqrt(2 * pi() * (4 * h{j} + kv[c])) * exp(0 - 0.5 * (y - 2 * g{j} - km[c]) ** 2 / (4 * h{j} + kv[c]))"
        x = f"SELECT *, {', '.join(f'list_transform(range(1, 11), lambda c: {part.format(j=j)}) AS l{j}' for j in n)} FROM (SELECT *, {w} AS kw, {m} AS km, {v} AS kv FROM ({x}))"
        moved = "(g{j} + 2 * h{j} / (4 * h{j} + kv[c]) * (y - 2 * g{j} - km[c]))"
        x = f"SELECT *, {', '.join(f'list_sum(list_transform(range(1, 11), lambda c: l{j}[c] * {moved.format(j=j)})) / list_sum(l{j}) AS n{j}' for j in n)} FROM ({x})"
        x = f"SELECT *, {', '.join(f'list_sum(list_transform(range(1, 11), lambda c: l{j}[c] * ((1 - 4 * h{j} / (4 * h{j} + kv[c])) * h{j} + ({moved.format(j=j)} - n{j}) ** 2))) / list_sum(l{j}) AS o{j}' for j in n)} FROM ({x})"
        x = f"SELECT *, {' + '.join(f'c{j} * list_sum(l{j})' for j in n)} AS total FROM ({x})"
        return f"SELECT series_id, seq, rn, {', '.join(f'c{j} * list_sum(l{j}) / total AS p{j}, n{j} AS m{j}, o{j} AS v{j}' for j in n)}, ln(total) AS loglik FROM ({x})"

    first = step("SELECT t.*, " + ", ".join(f"0.25::DOUBLE AS p{j}, {r[1]!r}::DOUBLE AS m{j}, 0.1::DOUBLE AS v{j}" for j, r in enumerate(REGIMES)) + " FROM t WHERE rn = 1")
    later = step(f"SELECT t.*, {state} FROM f JOIN t ON t.series_id = f.series_id AND t.rn = f.rn + 1")
    level = " + ".join(f"p{j} * m{j}" for j in n)
    variance = " + ".join(f"p{j} * (v{j} + (m{j} - ({level})) ** 2)" for j in n)
    best = "list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1"
    return f"""WITH RECURSIVE {s.TICKS_SQL}, {REGIME_SQL}, t AS MATERIALIZED (SELECT series_id, seq, rn, y FROM regimes), f AS ({first} UNION ALL {later})
      SELECT series_id, seq, {best} AS est_regime, round({level}, 7) + 0.0 AS log_vol, round({variance}, 7) AS variance, round(loglik, 7) + 0.0 AS loglik FROM f"""


@query(_bank_sql())
def kalman_bank(spark, sf_dir):
    return _bank(spark, sf_dir).select(KEY, "seq", "est_regime", rounded("log_vol", 7).alias("log_vol"), rounded("variance", 7).alias("variance"), rounded("loglik", 7).alias("loglik"))


@query()
def watchdog_flags(spark, sf_dir):
    rows = _bank(spark, sf_dir).withColumn("ess", 1 / F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x) / 4)
    return folded(rows, ["ess", "loglik", "log_vol", "variance", "y", "ret", "est_regime"], k.Watchdog).select(KEY, "seq", "flags", "severity")


@query(f"""WITH {s.TICKS_SQL}, {REGIME_SQL}, n AS (SELECT regime, lead(regime) OVER (PARTITION BY series_id ORDER BY ts, seq) AS nxt FROM regimes),
  p AS (SELECT regime, avg((nxt = regime)::INT) AS stay FROM n WHERE nxt IS NOT NULL GROUP BY regime)
  SELECT regime, round(stay, 9) AS stay, round({clip_sql(f"1 - (1 - {clip_sql('stay', 0.5, 0.999)}) / 3", 0.95, 0.9999)}, 9) AS factor FROM p""")
def dwell_forgetting(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("nxt", F.lead("regime").over(f.by(KEY, ORDER))).where("nxt is not null")
    stay = rows.groupBy("regime").agg(F.avg((F.col("nxt") == F.col("regime")).cast("int")).alias("stay"))
    clipped = F.greatest(F.least("stay", F.lit(0.999)), F.lit(0.5))
    return stay.select("regime", rounded("stay").alias("stay"), rounded(F.greatest(F.least(1 - (1 - clipped) / 3, F.lit(0.9999)), F.lit(0.95))).alias("factor"))
