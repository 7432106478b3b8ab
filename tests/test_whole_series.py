"""Queries and reducers that must read whole series, not their first or last ticks."""

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tickweave.operators import kernels as k
from tickweave.operators import samplers as sm
from tickweave.operators.fold import ordered_reduce
from tickweave.operators.spool import Spool
from tickweave.plans import catalogue


def test_paths_that_part_late_are_told_apart(spark):
    rows = [(s, t, int(t == 40 and s == 2)) for s in (1, 2, 3) for t in range(60)]
    frame = spark.createDataFrame(rows, "s long, t long, regime int").repartition(5)
    paths = {r["s"]: (bytes(r["path"]), r["n"]) for r in ordered_reduce(frame, "s", ["t"], ["regime"], k.PathDigest, k.PathDigest.OUTPUTS).collect()}
    assert paths[1] == paths[3] != paths[2] and paths[2][1] == 60


def test_every_return_gets_a_weight(spark):
    from tickweave.sources import ticks

    assert catalogue.QUERIES["deferred_weights"](spark, SF_SMALL).count() == ticks.returns(spark, SF_SMALL).count()


def test_spool_gives_all_numbers_back_each_time():
    numbers = np.random.default_rng(3).normal(size=1003)
    spool = Spool(block=100)
    for x in numbers:
        spool.append(x)
    assert len(spool.part) == 3 and (spool.first, spool.last) == (numbers[0], numbers[-1])
    for _ in range(2):
        assert list(spool) == numbers.tolist() and spool.mean() == pytest.approx(numbers.mean())


def test_chain_sees_the_first_ticks():
    y = np.random.default_rng(4).normal(-9, 1.5, 700)

    def fit(shift):
        chain = sm.Pmmh(("a",), particles=16, steps=6, burn=2)
        for v in [*(y[:500] + shift), *y[500:]]:
            chain.push(v)
        return chain.finish()[0]

    assert fit(0)[6] != fit(3.0)[6] and fit(0)[7] == 700
    parts = [np.asarray(p) for p in sm._blocks(y)]
    assert np.concatenate(parts).tolist() == y.tolist() and max(map(len, parts)) <= 512


def test_likelihoods_of_many_chains_are_those_of_each():
    rng = np.random.default_rng(8)
    series = [np.log((np.exp(-4.5) * rng.standard_normal(n)) ** 2) for n in (600, 300, 256, 12, 257)]
    run = lambda which: sm.bootstrap_logliks([series[i] for i in which], [0.9] * len(which), [-4.5] * len(which), [0.2] * len(which), 500, [np.random.default_rng(i) for i in which])
    together, alone = run(range(5)), [run([i])[0] for i in range(5)]
    assert together == pytest.approx(alone, abs=1e-6)

    def plain(y, n=3000):
        draw, total, h = np.random.default_rng(1), 0.0, None
        for obs in y:
            h = -4.5 + 0.2 / np.sqrt(1 - 0.81) * draw.standard_normal(n) if h is None else -4.5 + 0.9 * (h + 4.5) + 0.2 * draw.standard_normal(n)
            w = np.exp(0.5 * (obs - 2 * h) - 0.5 * np.exp(obs - 2 * h)) / np.sqrt(2 * np.pi)
            total, h = total + np.log(w.mean()), draw.choice(h, n, p=w / w.sum())
        return total

    assert together == pytest.approx([plain(y) for y in series], abs=2.5)
    keys = [(i,) for i in range(5)]
    rows = sm.PmmhBank(2, particles=32, steps=6, burn=2).run(keys, series)
    assert [r for r in rows if r[0] == 2] == [(2, r) for _, r in sm.PmmhBank(2, particles=32, steps=6, burn=2).run([keys[2]], [series[2]])]


def test_consecutive_windows_cover_every_tick(spark):
    y = np.random.default_rng(5).normal(-9, 1.5, 250)
    frame = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)], "s string, t long, y double")
    make = lambda key: sm.Consecutive(key, sm.Paris, window=100, least=20, particles=8, paths=4)
    rows = ordered_reduce(frame, "s", ["t"], ["y"], make, f"first_tick long, {sm.Paris.OUTPUTS}", keyed=True).collect()
    assert sorted(r["tick"] for r in rows) == list(range(250)) and {r["first_tick"] for r in rows} == {0, 100, 200}
    short = sm.Consecutive(("a",), sm.Paris, window=100, least=20, particles=8, paths=4)
    found = [row for v in y[:110] for row in short.push(v) or ()] + short.finish()
    assert [row[1] for row in found] == list(range(110))


def test_smoother_query_has_every_tick(spark):
    from tickweave.plans.folds import labelled

    assert catalogue.QUERIES["paris_smooth"](spark, SF_SMALL).count() == labelled(spark, SF_SMALL).count()


def test_garch_fits_all_returns():
    rng = np.random.default_rng(6)
    r = np.concatenate([rng.normal(0, 0.05, 500), rng.normal(0, 0.01, 2000)])
    fit = sm.Garch()
    for x in r:
        fit.push(x)
    omega, alpha, beta, value, n, _ = fit.finish()[0]
    assert n == 2500 and omega == pytest.approx(r.var() * (1 - alpha - beta))
    assert value == pytest.approx(sm.Garch.loglik((r - r.mean()) ** 2, r.var(), np.array([alpha]), np.array([beta]))[0])


def test_hawkes_fits_all_events():
    times = np.cumsum(np.random.default_rng(7).exponential(1.0, 700)).tolist()
    fit = k.HawkesMle(steps=5)
    for x in times:
        fit.push(x)
    mu, alpha, beta, value, n = fit.finish()[0]
    assert n == 700 and value == pytest.approx(k.HawkesMle.loglik(times, mu, alpha, beta))


def grid_loglik(y, phi, mu, sigma):
    """The likelihood by sums over a fine grid of log-volatilities."""
    sd = sigma / np.sqrt(1 - phi * phi)
    h = np.linspace(-8, 8, 1201) * sd
    move = np.exp(-0.5 * ((h[None] - phi * h[:, None]) / sigma) ** 2)
    move /= move.sum(1, keepdims=True)
    p, total = np.exp(-0.5 * (h / sd) ** 2), 0.0
    for obs in y:
        d = obs - 2 * (h + mu)
        like = 0.5 * (d - np.exp(d)) - 0.5 * np.log(2 * np.pi)
        w = p / p.sum() * np.exp(like - like.max())
        total += like.max() + np.log(w.sum())
        p = w @ move
    return total


@pytest.mark.parametrize("n", [256, 253])
def test_estimated_likelihoods_are_unbiased_and_narrow(n):
    rng = np.random.default_rng(9)
    y = np.log((np.exp(-4.5) * rng.standard_normal(150)) ** 2)
    y[70] += 7  # a shock of thirty deviations
    for phi, mu, sigma in ((0.76, -4.4, 0.2), (0.95, -4.6, 0.3)):
        exact = grid_loglik(y, phi, mu, sigma)
        found = sm.bootstrap_logliks([y] * 300, [phi] * 300, [mu] * 300, [sigma] * 300, n, [np.random.default_rng([1, i]) for i in range(300)])
        calm = sm.bootstrap_logliks([y[:70]] * 300, [phi] * 300, [mu] * 300, [sigma] * 300, n, [np.random.default_rng([2, i]) for i in range(300)])
        assert np.isfinite(found).all() and abs(found.max() - exact) < 25
        assert np.log(np.exp(calm - calm.max()).mean()) + calm.max() == pytest.approx(grid_loglik(y[:70], phi, mu, sigma), abs=0.1) and calm.std() < 0.5
        tape = sm.Tape([y[:70]])
        assert sm.gaussian_logliks(tape, np.array([0]), [phi], [mu], [sigma])[0] == pytest.approx(grid_loglik(y[:70], phi, mu, sigma), abs=0.5)


def test_impossible_series_keeps_its_block_going():
    y = np.random.default_rng(2).normal(-9, 1.5, 80)
    rngs = lambda: [np.random.default_rng(i) for i in range(2)]
    bad = np.where(np.arange(80) == 40, np.inf, y)
    found = sm.bootstrap_logliks([y, bad], [0.8] * 2, [-4.5] * 2, [0.2] * 2, 64, rngs())
    assert found[1] == -np.inf and found[0] == sm.bootstrap_logliks([y, y], [0.8] * 2, [-4.5] * 2, [0.2] * 2, 64, rngs())[0]


def test_tape_gives_every_tick_of_any_columns(monkeypatch):
    series = [np.arange(n, dtype=float) + 1000 * n for n in (200, 130, 64, 63, 1)]
    held = sm.Tape(series)
    monkeypatch.setattr(sm.Tape, "HELD", 0)
    again = sm.Tape(series)
    assert held.held is not None and again.held is None
    for columns in ([0, 0, 1, 2, 3, 4], [1, 2, 2], [3, 4], [4], [2]):
        for tape in (held, again):
            found = [[] for _ in columns]
            for chunk in tape.chunks(np.array(columns)):
                for j in range(chunk.shape[1]):
                    found[j] += chunk[:, j].tolist()
            for x, c in zip(found, columns):
                assert x[: len(series[c])] == series[c].tolist() and not any(x[len(series[c]) :])


def test_delayed_acceptance_spares_particles_and_keeps_the_posterior(monkeypatch):
    rng = np.random.default_rng(11)
    y, ran, run = np.log((np.exp(-4.2) * rng.standard_normal(60)) ** 2), [], sm._bootstrap
    monkeypatch.setattr(sm, "_bootstrap", lambda tape, columns, *rest: ran.append(len(columns)) or run(tape, columns, *rest))

    def fit():
        rows = sm.PmmhBank(24, particles=64, steps=500, burn=100).run([("a",)], [y])
        assert [r[1][0] for r in rows] == list(range(24)) and all(r[1][8] == 60 for r in rows)
        return np.mean([r[1][1:6] for r in rows], 0)

    usual = fit()
    assert sum(ran) < 0.5 * 24 * 500
    near = sm.gaussian_logliks
    monkeypatch.setattr(sm, "gaussian_logliks", lambda tape, columns, phi, mu, sigma: 0.5 * near(tape, columns, phi, mu, sigma))  # a poor one
    poor = fit()
    monkeypatch.setattr(sm, "gaussian_logliks", lambda tape, columns, *_: np.zeros(len(columns)))  # none
    assert usual == pytest.approx(poor, abs=0.04) and usual == pytest.approx(fit(), abs=0.04)


def test_every_core_gets_a_block_of_series(spark):
    frame = spark.range(40 * 30).selectExpr("id % 40 as s", "id as t", "cast(id as double) y")

    class Sums:
        def run(self, keys, series):
            return [(i, (float(sum(x)), len(x))) for i, x in enumerate(series)]

    from tickweave.operators.fold import blocked_reduce

    rows = blocked_reduce(frame, "s", ["t"], "y", Sums, "total double, n long", width=5)
    sizes = [r["count"] for r in rows.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert sorted((r["s"], r["total"], r["n"]) for r in rows.collect()) == [(s, float(sum(range(s, 1200, 40))), 30) for s in range(40)]
    assert rows.rdd.getNumPartitions() == len(sizes) >= 7 and max(sizes) < 15
