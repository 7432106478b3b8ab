import math
import statistics

import pytest
from pyspark.sql import functions as F

from tickweave.functions import presets, register
from tickweave.operators import durations, features, ranges, reports, resample
from tickweave.operators import kernels as k
from tickweave.operators import particles as pt
from tickweave.sources import sinks, ticks


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, t, 100.0 + ((t * 7 + s * 3) % 11)) for s in (1, 2) for t in range(30)]
    return spark.createDataFrame(rows, "s long, t long, px double")


def values(frame, column, where="s = 1"):
    return [r[column] for r in frame.where(where).orderBy("t").collect()]


def test_rolling_deviation_is_null_until_full(series):
    got = values(features.rolling_std(series, "s", ["t"], "px", 5, "v"), "v")
    px = values(series, "px")
    assert got[:4] == [None] * 4
    assert got[4:] == pytest.approx([statistics.stdev(px[i - 4 : i + 1]) for i in range(4, 30)])


def test_winsorised_values_and_flags(series):
    px = values(series, "px")
    m, d = statistics.mean(px), statistics.pstdev(px)
    assert values(features.winsorize(series, "s", "px", 1.0, "v"), "v") == pytest.approx([min(max(x, m - d), m + d) for x in px])
    assert values(features.outlier_flags(series, "s", "px", 1.0, "v"), "v") == [abs(x - m) > d for x in px]


def test_runs_and_fixed_lag(series):
    rows = features.runs(series.withColumn("state", F.floor(F.col("t") / 4) % 2), "s", ["t"], "state")
    assert values(rows, "run_age") == [t % 4 + 1 for t in range(30)] and values(rows, "run_id") == [t // 4 for t in range(30)]
    lagged = features.fixed_lag(series, "s", ["t"], "px", 3, "x")
    px = values(series, "px")
    assert values(lagged, "x") == px[:2] + px[:28] and values(lagged, "x_valid") == [False] * 2 + [True] * 28


def test_losses_ignore_missing_pairs(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", None, 1.0), ("a", 3.0, None)], "m string, y double, f double")
    out = reports.losses(rows, ["m"], "y", "f").first()
    assert out["n"] == 2 and out["rmse"] == pytest.approx(math.sqrt(0.5)) and out["mae"] == 0.5
    few = reports.mincer_zarnowitz(rows, ["m"], "y", "f").first()
    assert few["beta"] is None


def test_diebold_mariano_with_lags(spark):
    a, b = [float((i * 7) % 5) for i in range(40)], [float((i * 3) % 7) for i in range(40)]
    rows = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(zip(a, b))], "s long, t long, a double, b double")
    out = {(r["a"], r["b"]): r for r in reports.diebold_mariano(rows, ["s", "t"], ["a", "b"], lags=2).collect()}
    assert out["a", "b"]["mean_diff"] == pytest.approx(-out["b", "a"]["mean_diff"]) == pytest.approx(statistics.mean(x - y for x, y in zip(a, b)))
    assert out["a", "b"]["statistic"] == pytest.approx(-out["b", "a"]["statistic"])


def test_detections_across_blocks(spark):
    changes = spark.createDataFrame([(1, 5), (1, 11), (1, 40), (2, 5)], "s long, at long")
    alarms = spark.createDataFrame([(1, 14), (1, 7), (1, 39), (1, 52), (2, 16)], "s long, at long")
    got = {(r["s"], r["at"]): r["lag"] for r in reports.detections(changes, alarms, "s", "at", 10).collect()}
    assert got == {(1, 5): 2, (1, 11): 3, (1, 40): None, (2, 5): None}
    wrong = sorted(map(tuple, reports.false_alarms(changes, alarms, "s", "at", 10).collect()))
    assert wrong == [(1, 39), (1, 52), (2, 16)]


def test_duration_table(spark):
    rows = spark.createDataFrame([(0, 1, True), (0, 2, True), (0, 2, False), (0, 4, True)], "state int, length int, closed boolean")
    got = {r["age"]: r for r in durations.duration_table(rows, "state", "length", "closed").collect()}
    assert got[1]["at_risk"] == 4 and got[1]["hazard"] == 0.25 and got[2]["hazard"] == pytest.approx(1 / 3) and got[4]["hazard"] == 1.0
    assert got[2]["survival"] == pytest.approx(0.75 * 2 / 3) and got[1]["remaining"] == pytest.approx(9 / 4 - 1)


def test_systematic_counts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 7)
    weights = [((i * 13) % 9) + 1.0 for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(weights)), "id long, w double")
    got = {r["id"]: r["copies"] for r in resample.systematic_counts(rows, "id", "w", 100, 0.4).collect()}
    want, edge, total = dict.fromkeys(range(40), 0), 0.0, sum(weights)
    for i in range(100):
        point, at, edge = (i + 0.4) / 100 * total, 0, weights[0]
        while point >= edge:
            at += 1
            edge += weights[at]
        want[at] += 1
    assert got == want and sum(got.values()) == 100


def test_large_tables_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BROADCAST_RANGES", 1)
    table = spark.createDataFrame([("a", 0, 3, 1), ("b", 2, 5, 2)], "label string, start int, end int, priority int")
    rows = spark.range(7).select(F.col("id").cast("int").alias("t"))
    assert [r["label"] for r in ranges.label_ranges(rows, table, "t").orderBy("t").collect()] == ["a", "a", "b", "b", "b", "b", None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.1, 0.2], "x")], "t int, p array<double>, m string")
    sinks.write(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back["p_0"] == "0.1" and back["p_1"] == "0.2" and "p_2" not in back
    longer = spark.createDataFrame([(1, [0.5] * 11), (2, [0.1]), (3, None)], "t int, p array<double>")
    flat = {r["t"]: r for r in sinks.flatten(longer).collect()}
    assert flat[1]["p_10"] == 0.5 and flat[2]["p_0"] == 0.1 and flat[2]["p_1"] is None and flat[3]["p_0"] is None and "p_11" not in flat[1]
    with pytest.raises(Exception, match="more than 8 values"):
        sinks.flatten(longer, 8).collect()
    sinks.tuner_table(spark.createDataFrame([(1.0, 0.3), (2.0, 0.1)], "knob double, score double"), str(tmp_path / "tuned"))
    assert [r["knob"] for r in spark.read.option("header", True).csv(str(tmp_path / "tuned")).collect()] == ["2.0", "1.0"]
    sinks.write(rows, str(tmp_path / "pq"), partition_by=["m"])
    assert spark.read.parquet(str(tmp_path / "pq")).first()["p"] == [0.1, 0.2]
    long = spark.createDataFrame([("rmse", "a", 1.0), ("rmse", "b", 2.0)], "metric string, model string, v double")
    assert sinks.matrix(long, "metric", "model", "v", ["a", "b"]).first()["b"] == 2.0
    scope: dict = {}
    exec(sinks.snippet({"stay": 0.9, "n": 64}), scope)
    assert scope["TunedFilter"] == {"stay": 0.9, "n": 64} and sinks.key_values({"b": 1, "a": 2}) == [("a", 2.0), ("b", 1.0)]


def test_presets_build_filters(spark):
    assert presets.presets(spark).count() == 7
    for asset, *_ in presets.PRESETS:
        machine = pt.ParticleFilter(("k",), n=32, **presets.options(asset))
        assert math.isfinite(machine.step(-9.0)[0])


def test_sql_functions(spark):
    names = register.register(spark)
    assert len(names) == len(register.FUNCTIONS)
    row = spark.sql("SELECT tw_log_square(0.01D) AS a, tw_log_square(0D) AS b, tw_fisher_rao_distance(0D, 1D, 0D, 1D) AS c, tw_kelly_multiplier(1D, 10D, 0.5D) AS d").first()
    assert row["a"] == pytest.approx(math.log(1e-4)) and row["b"] == -23.0 and row["c"] == 0.0 and row["d"] == 0.5


def test_tempering_and_session_learning():
    t = k.KlTempering(particles=16, wait=5)
    assert t.step(100.0)[0] == pytest.approx(max(0.1, math.log(16) / 100)) and t.step(0.1)[0] == 1.0
    d = k.OnlineDiurnal(bins=2, least=3)
    out = [d.step(0.02 if i % 2 else 0.01, i % 2) for i in range(200)]
    assert out[0][0] == 1.0 and out[-1][0] > 1.0 > out[-2][0]


def test_hawkes_likelihood_fit_beats_its_start():
    times = [i * 5 + (0.3 if i % 3 == 0 else 0.0) + j * 0.2 for i in range(40) for j in range(1 + 2 * (i % 4 == 0))]
    fit = k.HawkesMle()
    for t in sorted(times):
        fit.push(t)
    ((mu, alpha, beta, value, n),) = fit.finish()
    rate = len(times) / (times[-1] - times[0])
    assert n == len(times) and 0 < alpha < 1 and value > k.HawkesMle.loglik(sorted(times), rate / 2, 0.49, rate)


def test_alignment_of_series(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "ts long, close double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "ts long, close double")
    assert [tuple(r) for r in ticks.align({"a": a, "b": b}).collect()] == [(2, 2.0, 5.0)]
