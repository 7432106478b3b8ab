"""Aggregate reports: forecast losses, tests, confusion, runs, transitions, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.features import by


def hawkes_moments(events: DataFrame, key: str, order, hours: Column, least: int = 100) -> DataFrame:
    """n_events, mu, branching, beta per key from the moments of the gaps between events.

    ``hours`` is the time of an event; keys with fewer than ``least`` gaps get
    (0.05, 0.5, 0.1).
    """
    gaps = events.withColumn("gap", hours - F.lag(hours).over(by(key, order)))
    each = gaps.groupBy(key).agg(F.count("gap").alias("n"), F.avg("gap").alias("m"), F.var_samp("gap").alias("v"))
    cv2 = F.try_divide(F.col("v"), F.col("m") * F.col("m"))
    clip = lambda x, a, b: F.greatest(F.least(x, F.lit(b)), F.lit(a))
    branching, few = clip((cv2 - 1) / (cv2 + 1), 0.1, 0.9), F.col("n") < least
    return each.select(
        key, (F.col("n") + 1).alias("n_events"), F.when(few, 0.05).otherwise(clip(F.try_divide(1 - branching, F.col("m")), 0.01, 0.5)).alias("mu"),
        F.when(few, 0.5).otherwise(branching).alias("branching"), F.when(few, 0.1).otherwise(clip(F.try_divide(F.lit(0.693), 2 * F.col("m")), 0.02, 0.5)).alias("beta"),
    )


def losses(pairs: DataFrame, keys: list[str], truth: str, forecast: str) -> DataFrame:
    """rmse, mae, qlike and n by key; pairs with a null are left out, variances have a floor of 1e-10."""
    rows = pairs.where(F.col(truth).isNotNull() & F.col(forecast).isNotNull())
    error, variance = F.col(truth) - F.col(forecast), F.greatest(F.col(forecast) * F.col(forecast), F.lit(1e-10))
    return rows.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        F.avg(F.log(variance) + F.col(truth) * F.col(truth) / variance).alias("qlike"), F.count(F.lit(1)).alias("n"),
    )


def mincer_zarnowitz(pairs: DataFrame, keys: list[str], truth: str, forecast: str, least: int = 10) -> DataFrame:
    """Regression of true on forecast variances: alpha, beta, r2 and the t value of beta = 1; null below ``least`` pairs."""
    rows = pairs.where(F.col(truth).isNotNull() & F.col(forecast).isNotNull()).withColumn("__y", F.col(truth) ** 2).withColumn("__x", F.col(forecast) ** 2)
    y, x = F.col("__y"), F.col("__x")
    each = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    beta = F.try_divide(F.col("sxy"), F.col("sxx"))
    rest = F.col("syy") - beta * F.col("sxy")
    t = F.try_divide(beta - 1, F.sqrt(F.greatest(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("sxx")), F.lit(0.0))))
    ok = lambda c: F.when(F.col("n") >= least, c)
    return each.select(*keys, "n", ok(F.col("my") - beta * F.col("mx")).alias("alpha"), ok(beta).alias("beta"), ok(1 - F.try_divide(rest, F.col("syy"))).alias("r2"), ok(t).alias("t_beta"))


def diebold_mariano(losses_wide: DataFrame, order: list[str], models: list[str], lags: int = 1) -> DataFrame:
    """Every ordered pair of models: mean loss difference and its statistic with Newey-West weights.

    ``losses_wide`` has a loss column per model. All pairs share one pass over one
    ordering; the models are few, so the pairs are columns.
    """
    from pyspark.sql import Window

    pairs = [(a, b) for a in models for b in models if a != b]
    rows = losses_wide.select(*order, *[(F.col(a) - F.col(b)).alias(f"{a}__{b}") for a, b in pairs])
    w = Window.partitionBy(order[0]).orderBy(*order[1:])
    lagged = rows.select("*", *[F.lag(f"{a}__{b}", h).over(w).alias(f"{a}__{b}__{h}") for a, b in pairs for h in range(1, lags)])
    out = None
    aggregates = []
    for a, b in pairs:
        d = f"{a}__{b}"
        variance = F.var_pop(d)
        for h in range(1, lags):
            variance = variance + 2 * (1 - h / lags) * F.covar_pop(d, f"{d}__{h}")
        aggregates += [F.avg(d).alias(f"m__{d}"), variance.alias(f"v__{d}"), F.count(d).alias(f"n__{d}")]
    one = lagged.agg(*aggregates)
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m__{a}__{b}").alias("mean_diff"), F.try_divide(F.col(f"m__{a}__{b}"), F.sqrt(F.greatest(F.try_divide(F.col(f"v__{a}__{b}"), F.col(f"n__{a}__{b}")), F.lit(0.0)))).alias("statistic")) for a, b in pairs]
    out = one.select(F.explode(F.array(*entries)).alias("e"))
    return out.select("e.*")


def confusion(frame: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, n and the share of the truth's row."""
    cells = frame.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("truth").agg(F.sum("n").alias("__all"))
    return cells.join(rows, "truth").select("truth", "guess", "n", (F.col("n") / F.col("__all")).alias("share"))


def class_report(frame: DataFrame, truth: str, guess: str) -> DataFrame:
    """precision, recall, f1 and support of every class."""
    cells = frame.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("truth") == F.col("guess")
    real = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    said = cells.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("said"))
    both = real.join(said, "class", "full").na.fill(0, ["support", "hits", "said"])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("hits"), F.col("said")), safe(F.col("hits"), F.col("support"))
    return both.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def transition_counts(frame: DataFrame, key, order, state: str) -> DataFrame:
    """from_state, to_state, n over neighbouring ticks of each series."""
    rows = frame.select(F.col(state).alias("from_state"), F.lead(state).over(by(key, order)).alias("to_state"))
    return rows.where("to_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def transition_matrix(counts: DataFrame, states: int, prior: float = 1.0, sticky: float = 0.0) -> DataFrame:
    """from_state, to_state, p for all pairs: counts plus a prior, rows normalised; states x states rows."""
    spark = counts.sparkSession
    grid = spark.range(states * states).select((F.col("id") / states).cast("int").alias("from_state"), (F.col("id") % states).cast("int").alias("to_state"))
    weight = F.coalesce("n", F.lit(0)) + prior + F.when(F.col("from_state") == F.col("to_state"), sticky).otherwise(0.0)
    rows = grid.join(counts, ["from_state", "to_state"], "left").withColumn("w", weight)
    sums = rows.groupBy("from_state").agg(F.sum("w").alias("s"))
    return rows.join(sums, "from_state").select("from_state", "to_state", (F.col("w") / F.col("s")).alias("p"))


def detections(changes: DataFrame, alarms: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """Every change point with the first alarm in [at, at + within): lag, or null if it was missed.

    An equi-join on key and block of time, so that no task compares all pairs of a
    series: an alarm lies in the block of the change or the next one.
    """
    block = lambda c: F.floor(c / within)
    a = alarms.select(key, F.col(at).alias("__alarm"), block(F.col(at)).alias("__b"))
    c = changes.select(key, F.col(at).alias("at")).distinct().select(key, "at", F.explode(F.array(block(F.col("at")), block(F.col("at")) + 1)).alias("__b"))
    near = (F.col("__alarm") >= F.col("at")) & (F.col("__alarm") < F.col("at") + within)
    return c.join(a, [key, "__b"], "left").groupBy(key, "at").agg(F.min(F.when(near, F.col("__alarm") - F.col("at"))).alias("lag"))


def false_alarms(changes: DataFrame, alarms: DataFrame, key: str, at: str, within: int) -> DataFrame:
    """Alarms that no change point precedes within the window."""
    block = lambda c: F.floor(c / within)
    c = changes.select(F.col(key).alias("__k"), F.col(at).alias("__at")).distinct().select("__k", "__at", F.explode(F.array(block(F.col("__at")), block(F.col("__at")) + 1)).alias("__b"))
    near = (F.col(key) == F.col("__k")) & (block(F.col(at)) == F.col("__b")) & (F.col(at) >= F.col("__at")) & (F.col(at) < F.col("__at") + within)
    return alarms.join(c, near, "left_anti")


def silverman(frame: DataFrame, key: str, value: str) -> DataFrame:
    """bandwidth per key: 0.9 min(deviation, IQR / 1.34) n^-0.2, with a floor where values don't vary.

    Quartiles are the order statistics at n / 4 and 3 n / 4, taken from a ranking
    rather than from collected values.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    rows = frame.select(key, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    each = rows.groupBy(key).agg(
        F.first("n").alias("n"), F.stddev_pop("v").alias("sd"),
        F.max(F.when(F.col("i") == F.floor(F.col("n") / 4), F.col("v"))).alias("q1"), F.max(F.when(F.col("i") == F.floor(3 * F.col("n") / 4), F.col("v"))).alias("q3"),
    )
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    spread = F.when(iqr > 1e-10, F.least("sd", iqr)).otherwise(F.col("sd"))
    return each.select(key, F.when(F.col("sd") < 1e-10, F.lit(0.01)).otherwise(0.9 * spread * F.pow("n", F.lit(-0.2))).alias("bandwidth"))


def weight_summary(frame: DataFrame, key: str, log_weight: str) -> DataFrame:
    """ess, entropy, normalised entropy and log sum of weights per key, by a shifted log-sum-exp in two aggregations."""
    top = frame.groupBy(key).agg(F.max(log_weight).alias("__top"))
    rows = frame.join(top, key).withColumn("__w", F.exp(F.col(log_weight) - F.col("__top")))
    each = rows.groupBy(key).agg(F.sum("__w").alias("s"), F.sum(F.col("__w") * F.col("__w")).alias("q"), F.sum(F.col("__w") * (F.col(log_weight) - F.col("__top"))).alias("x"), F.max("__top").alias("top"), F.count(F.lit(1)).alias("n"))
    entropy = F.log("s") - F.col("x") / F.col("s")
    return each.select(key, (F.col("s") * F.col("s") / F.col("q")).alias("ess"), entropy.alias("entropy"), F.when(F.col("n") > 1, entropy / F.log("n")).alias("norm_entropy"), (F.log("s") + F.col("top")).alias("log_sum"))


def weight_kl(frame: DataFrame, key: str, old_log_weight: str, increment: str) -> DataFrame:
    """KL divergence of updated from old weights per key, at least zero."""
    top = frame.groupBy(key).agg(F.max(F.col(old_log_weight) + F.col(increment)).alias("__t1"), F.max(old_log_weight).alias("__t0"))
    rows = frame.join(top, key)
    new, old = F.exp(F.col(old_log_weight) + F.col(increment) - F.col("__t1")), F.exp(F.col(old_log_weight) - F.col("__t0"))
    each = rows.groupBy(key).agg(F.sum(new).alias("z1"), F.sum(old).alias("z0"), F.sum(new * F.col(increment)).alias("x"), F.max("__t1").alias("t1"), F.max("__t0").alias("t0"))
    kl = F.col("x") / F.col("z1") - (F.log("z1") + F.col("t1")) + (F.log("z0") + F.col("t0"))
    return each.select(key, F.greatest(kl, F.lit(0.0)).alias("kl"))
