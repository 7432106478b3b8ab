"""Filters of many series at once, and the samplers that feed them, against plain versions."""

import math
import random

import numpy as np
import pytest

from tickweave.functions.fixed import MIXTURE_MEANS, MIXTURE_VARIANCES, MIXTURE_WEIGHTS
from tickweave.operators import kernels as k
from tickweave.operators import particles as pt
from tickweave.operators import ranges
from tickweave.operators import samplers as sm
from tickweave.operators.counters import Draws, stream_of
from tickweave.operators.fold import aligned_fold, ordered_fold
from tickweave.plans import reports


def observations(seed, n, level=-4.5):
    rng = np.random.default_rng(seed)
    return np.log((np.exp(level) * rng.standard_normal(n)) ** 2)


def test_draws_depend_on_series_tick_and_use_alone():
    streams, ticks = np.array([stream_of(1, x) for x in "abc"], np.uint64), np.array([3, 5, 5])
    d = Draws(streams, ticks, 20_000)
    alone = Draws(streams[1:2], ticks[1:2], 20_000)
    assert (d.uniform(2)[1] == alone.uniform(2)[0]).all() and (d.normal(2, np.array([1])) == alone.normal(2)).all()
    assert abs(d.uniform(0).mean() - 0.5) < 0.01 and 0 < d.uniform(0).min() and d.uniform(0).max() < 1
    z, g = d.normal(1), d.gamma(2.5, 8)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z[0], z[1])[0, 1]) < 0.03
    assert abs(g.mean() - 2.5) < 0.05 and abs(g.var() - 2.5) < 0.15
    assert abs(np.corrcoef(d.uniform(0)[0], d.uniform(1)[0])[0, 1]) < 0.03


@pytest.mark.parametrize("extra", [None, (0.05, 30.0)])
def test_collapse_equals_the_sum_over_components(extra):
    def plain(m, v, y):
        parts = [(w, a, b) for w, a, b in zip(MIXTURE_WEIGHTS, MIXTURE_MEANS, MIXTURE_VARIANCES)]
        if extra:
            parts = [((1 - extra[0]) * w, a, b) for w, a, b in parts] + [(extra[0], 0.0, extra[1])]
        total, found = 0.0, []
        for w, a, b in parts:
            s = 4 * v + b
            e = y - 2 * m - a
            p = w * math.exp(-0.5 * e * e / s) / math.sqrt(2 * math.pi * s)
            total += p
            found.append((p, m + 2 * v / s * e, (1 - 4 * v / s) * v))
        mean = sum(p * x for p, x, _ in found) / total
        return math.log(total), mean, sum(p * (q + (x - mean) ** 2) for p, x, q in found) / total, found[-1][0] / total if extra else 0.0

    rng = np.random.default_rng(1)
    m, v, y = rng.normal(-4.5, 1, (40, 100)), rng.uniform(0.01, 0.5, (40, 100)), rng.normal(-9, 3, (40, 1))
    lik, mean, variance, out = pt.collapse(m, v, y, extra)
    for i, j in [(0, 0), (7, 3), (39, 99), (20, 50)]:
        want = plain(m[i, j], v[i, j], y[i, 0])
        assert (lik[i, j], mean[i, j], variance[i, j], out[i, j]) == pytest.approx(want, abs=2e-4)


def test_ancestors_of_rows():
    rng = np.random.default_rng(2)
    w, u = rng.random((30, 64)) ** 4, rng.random(30)
    for row, ancestors, x in zip(w, pt.systematic_rows(w, u), u):
        assert (ancestors == pt.systematic(row, x)).mean() > 0.95 and (np.diff(ancestors) >= 0).all()
        assert (np.abs(np.bincount(ancestors, minlength=64) - row / row.sum() * 64) <= 1.0001).all()


@pytest.mark.parametrize("options", [{}, {"learn": True, "nu": 5.0, "outlier": (0.02, 30.0)}, {"lookahead": (2.0, 0.5), "moves": 3, "mutation": 0.2}])
def test_series_of_a_bank_are_what_they_are_alone(options):
    lengths = [40, 25, 40, 7, 1]
    tapes = [observations(i, n) for i, n in enumerate(lengths)]
    bank = pt.Bank(64, **options)
    bank.add([("s", i) for i in range(5)])
    alone, seen = [pt.ParticleFilter(("s", i), n=64, **options) for i in range(5)], []
    for t in range(40):
        at = np.array([i for i in range(5) if t < lengths[i]])
        outs = bank.step(at, np.array([tapes[i][t] for i in at]))
        seen.append((t, at, outs))
    for t, at, outs in seen:  # also after later steps
        for row, i in enumerate(at):
            for a, b in zip(alone[i].step(tapes[i][t]), outs):
                assert a == b[row].tolist()


def test_aligned_fold_equals_a_filter_for_each_series(spark):
    rows = [(s, t, float(v)) for s, n in ((1, 30), (2, 12), (None, 20), (4, 1)) for t, v in enumerate(observations(n, n))]
    frame = spark.createDataFrame(rows, "s long, t long, y double").repartition(3)
    many = aligned_fold(frame, "s", ["t"], ["y"], lambda: pt.Bank(32), pt.Bank.OUTPUTS, width=2)
    one = ordered_fold(frame, "s", ["t"], ["y"], lambda key: pt.ParticleFilter(key, n=32), pt.Bank.OUTPUTS, keyed=True)
    get = lambda f: {(r["s"], r["t"]): r for r in f.collect()}
    a, b = get(many), get(one)
    assert set(a) == set(b) == {(s, t) for s, t, _ in rows}
    for key in a:
        assert a[key]["log_vol"] == pytest.approx(b[key]["log_vol"], abs=1e-6) and list(a[key]["p"]) == pytest.approx(list(b[key]["p"]), abs=1e-6)
    assert aligned_fold(frame.limit(0), "s", ["t"], ["y"], lambda: pt.Bank(32), pt.Bank.OUTPUTS).collect() == []


def test_geodesic_ends_and_middle():
    m, v = pt.geodesic_point(np.array([-5.0, -4.0]), np.array([0.1, 0.2]), np.array([-3.0, -4.0]), np.array([0.4, 0.8]), np.array([0.0, 0.5]))
    assert m == pytest.approx([-5.0, -4.0]) and v == pytest.approx([0.1, 0.4])
    m, v = pt.geodesic_point(-5.0, 0.1, -3.0, 0.4, 1.0)
    assert float(m) == pytest.approx(-3.0) and float(v) == pytest.approx(0.4)


def test_moves_stay_in_the_regime_and_adapt():
    bank = pt.Bank(200, moves=3, mutation=0)
    at = bank.add([("a",)])
    for y in observations(3, 400):
        bank.step(at, np.array([y]))
    assert bank.a["accept"][0] != 0.5
    for width, bolder in ((1e-4, True), (50.0, False)):  # steps that are nearly always, and hardly ever, taken
        c = {name: x.copy() for name, x in bank.a.items()}
        c["m"][:], c["scale"][:] = bank.level[c["regime"]], 1.0
        for t in range(100):
            bank._move(c, np.array([0]), Draws(c["stream"], c["tick"] + t, 200), np.array([-9.0]), np.array([[width]]))
        assert c["scale"][0] > 1.5 if bolder else c["scale"][0] < 0.7
        assert 0.1 <= c["scale"][0] <= 5.0
    c = {name: x.copy() for name, x in bank.a.items()}
    place = bank.place[c["regime"][0]]
    c["m"][0] = np.clip(c["m"][0], bank.bounds[place] + 1e-9, np.nextafter(bank.bounds[place + 1], -np.inf))
    bank._move(c, np.array([0]), Draws(c["stream"], c["tick"], 200), np.array([-9.0]), np.array([[0.3]]))
    assert (c["m"][0] >= bank.bounds[place]).all() and (c["m"][0] < bank.bounds[place + 1]).all()


def test_mutation_fills_empty_regimes():
    bank = pt.Bank(100, mutation=1.0, diversity=2)
    bank.add([("a",)])
    c = {name: x.copy() for name, x in bank.a.items()}
    c["regime"][:] = 0
    bank._mutate(c, np.array([0]), Draws(c["stream"], c["tick"], 100))
    assert (np.bincount(c["regime"][0], minlength=4)[1:] == 2).all()
    bank.mutation = 0.0
    c["regime"][:] = 0
    bank._mutate(c, np.array([0]), Draws(c["stream"], c["tick"], 100))
    assert (c["regime"][0] == 0).all()


def test_shock_is_undone_without_touching_what_was_learnt():
    m = pt.MultiModelBank(32, hold=3)
    at = m.add([("a",), ("b",)])
    for y in observations(4, 20):
        m.step(at, np.array([y, y]), np.exp(np.array([y, y]) / 2))
    before = [x.a["t"][0].copy() for x in m.models]
    m.inject(0)
    assert all((x.a["t"][0] == 1 / x.k).all() and x.a["boost"][0] == 9.0 and x.a["boost"][1] == 1.0 for x in m.models)
    for y in observations(5, 2):
        m.step(at, np.array([y, y]), np.exp(np.array([y, y]) / 2))
    learnt = [x.a["s2"][0].copy() for x in m.models]
    m.restore(0)
    assert all((x.a["t"][0] == t).all() and x.a["boost"][0] == 1.0 and (x.a["s2"][0] == s).all() for x, t, s in zip(m.models, before, learnt))


def test_teleport_uses_a_surprising_tick_once():
    bank, plain = pt.ShockedBank(256, limit=1e9, steps=30), pt.Bank(256)
    at, same = bank.add([("a",)]), plain.add([("a",)])
    for y in observations(6, 60, -5.0):
        out, ref = bank.step(at, np.array([y])), plain.step(same, np.array([y]))
    assert out[2][0] == 0.0 and out[0][0] == pytest.approx(ref[0][0])
    y, bank.limit = 0.0, 5.0  # a return of one
    out, ref = bank.step(at, np.array([y])), plain.step(same, np.array([y]))
    assert out[1][0] > 5 and 0 < out[2][0] < 1 and out[0][0] > ref[0][0] + 0.1 > -2
    assert (bank.a["logw"][0] == 0).all() and set(np.unique(bank.a["v"][0])) <= set(bank.sigma**2)


def test_extended_step_is_its_parts_in_order():
    """Excitation, forgetting and learnt transitions, recomputed from the outputs; tempering shrinks large moves."""
    ys, n = observations(7, 150), 64
    bank = pt.Extended(n, rebuild=25, wait=30)
    at = bank.add([("a",)])
    hawkes, forgetting, counts, last = k.Hawkes(), k.AdaptiveForgetting(), np.where(np.eye(4, dtype=bool), 50.0, 1.0), None
    base = pt.sticky(4, 0.95)
    for t, y in enumerate(ys, 1):
        r = math.exp(y / 2) * (4 if t % 37 == 0 else 1)
        expected = np.array(k.hawkes_boost(base.tolist(), hawkes.now, hawkes.mu))
        log_vol, _, regime, _, surprise, outlier, intensity, temper, factor, broke, stay, _ = (x[0] for x in bank.step(at, np.array([y]), np.array([r])))
        assert bank.a["t"][0] == pytest.approx(expected)
        assert intensity == pytest.approx(hawkes.step(r, 0 if last is None else last)[0])
        want = forgetting.step(surprise, outlier, regime)
        assert (factor, broke) == (pytest.approx(want[0]), want[2]) and 0.1 <= temper <= 1
        if last is not None:
            counts *= 0.995
            counts[last, regime] += 1
        last = regime
        if t % 25 == 0:
            base = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
        assert stay == pytest.approx(base[regime, regime])
    tempered = pt.Extended(n, wait=30)
    tempered.add([("a",)])
    w = np.full((1, n), 1 / n)
    tempered.now = tempered.machines
    lik = np.where(np.arange(n) == 0, 0.0, -1e3)[None]
    assert tempered._reweigh(None, lik, w)[0, 0] == pytest.approx(min(1.0, math.log(n) / math.log(n)))


def test_missed_ticks_only_predict():
    bank = pt.CatchUpBank(128)
    at = bank.add([("a",)])
    for y in observations(8, 30):
        bank.step(at, np.array([y]))
    w, th = bank.weights(bank.a), bank.theta
    spread = bank.a["v"][0].mean()
    log_vol, seen = bank.step(at, np.array([np.nan]))
    assert not seen[0] and math.isfinite(log_vol[0]) and bank.a["v"][0].mean() > 0.5 * spread and w.sum() == pytest.approx(1) and len(th) == 4


def test_rescue_replaces_or_mixes_the_cloud():
    f = sm.Rescued(("a",), n=32, period=50, particles=12)
    out = [f.step(y) for y in observations(9, 130)]
    assert [t for t, o in enumerate(out) if o[2] == "periodic"] and all((o[2] is None) == (o[3] is None) for o in out)
    regime, h, w = np.array([0, 1, 2] * 4), np.linspace(-6, -3, 12), np.full(12, 1 / 12)
    rescue = {"mu": [-6.0, -5.0, -3.0], "sigma2": [0.01, 0.02, 0.03]}
    before = f.filter.m.copy()
    f.inject("mix", regime, h, w, rescue)
    assert (f.filter.m[1::2] == before[1::2]).all() and set(f.filter.m[::2]) <= set(h) and (f.filter.logw == 0).all()
    f.inject("replace", regime, h, w, rescue)
    assert set(f.filter.m) <= set(h) and (f.filter.mu == np.array(rescue["mu"])).all() and set(f.filter.v) <= set(rescue["sigma2"])


def test_alias_table():
    weights = [0.5, 3.0, 0.0, 1.5, 2.0]
    share, alias = sm.alias_table(weights)
    p = (share + np.bincount(alias, 1 - share, 5)) / 5
    assert p == pytest.approx(np.array(weights) / 7)
    drawn = sm.alias_draw(share, alias, (np.arange(100_000) + 0.5) / 100_000)
    assert np.bincount(drawn, minlength=5) / 100_000 == pytest.approx(np.array(weights) / 7, abs=1e-3)


def test_state_evidence_and_proposals():
    y = np.array([-9.0, -8.0, -11.0])
    grid = np.linspace(-20, 10, 20_001)
    x, v = (y + 1.27) / 2, 4.93 / 4
    density = np.exp(-0.5 * ((x[:, None] - grid) ** 2).sum(0) / v) * (2 * math.pi * v) ** -1.5 * np.exp(-0.5 * (grid + 4.5) ** 2 / (4.93 / 2)) / math.sqrt(2 * math.pi * 4.93 / 2)
    assert sm.StickyHdp._evidence(y) == pytest.approx(math.log(density.sum() * (grid[1] - grid[0])), abs=1e-6)
    rng = np.random.default_rng(1)
    apart = np.concatenate([np.log((np.exp(level) * rng.standard_normal(150)) ** 2) for level in (-7.0, -2.0, -7.0, -2.0)])
    for blocked in (False, True):
        sampler = sm.StickyHdp(("a",), window=600, sweeps=12, blocked=blocked)
        for value in apart:
            sampler.push(value)
        rows = sampler.finish()
        regimes, moves = sampler.export()
        assert 2 <= len(rows) < 30 and sum(r[2] for r in rows) == pytest.approx(1) and moves.sum(1) == pytest.approx(np.ones(len(regimes)))
        heavy = [r for r in rows if r[2] > 0.15]
        assert min(r[1] for r in heavy) < -6 and max(r[1] for r in heavy) > -3


def test_garch_path_is_the_recursion():
    path, r = reports.GarchPath(), [0.01, -0.02, 0.03]
    v, want = 1e-5 / (1 - 0.1 - 0.8), []
    for x in r:
        want.append(math.sqrt(v))
        v = 1e-5 + 0.1 * (x - 0.001) ** 2 + 0.8 * v
    assert [path.step(x, 1e-5, 0.1, 0.8, 0.001)[0] for x in r] == pytest.approx(want)
    assert reports.GarchPath().step(0.1, None, None, None, None) == (None,)


def test_pieces_make_up_a_range():
    for a, z in [(0, 0), (1, 15), (5, 22), (-7, 9), (61, 100_000), (3, (1 << 62) - 1), (4, 3)]:
        pieces = list(ranges.dyadic(a, z))
        at = a
        for level, index in pieces:
            assert index << level == at
            at += 1 << level
        assert at == max(a, z + 1) and len(pieces) <= 124


def test_range_labels_equal_brute_force(spark):
    r = random.Random(3)
    table = [(f"r{i}", (a := r.randint(-20, 60)), a + r.randint(-2, 30), r.randint(0, 4)) for i in range(25)] + [("n", None, 3, 9)]
    rows = [(t,) for t in range(-30, 100)] + [(None,)]
    out = ranges.label_ranges(spark.createDataFrame(rows, "t long"), spark.createDataFrame(table, "label string, start long, end long, priority int"), "t").collect()
    best = lambda t: max(((p, x) for x, a, z, p in table if t is not None and a is not None and a <= t <= z), default=(0, None))[1]
    assert {x["t"]: x["label"] for x in out} == {t: best(t) for (t,) in rows} and len(out) == len(rows)
    none = ranges.label_ranges(spark.createDataFrame(rows, "t long"), spark.createDataFrame([], "label string, start long, end long, priority int"), "t")
    assert none.where("label is not null").count() == 0


def test_watchdog_flags_and_resets():
    calls = []
    w = k.Watchdog(cooldown=2, most=2, on_reset=calls.append)
    good = (0.5, -2.0, -4.5, 0.1, -9.0, 0.01, 1)
    assert w.step(*good) == (0, 0)
    assert w.step(0.5, -2.0, 12.0, 0.1, -9.0, 0.01, 1) == (8, 3) and calls == [8]
    assert [w.step(0.5, -2.0, 12.0, 0.1, -9.0, 0.01, 1)[1] for _ in range(2)] == [0, 0]
    assert w.step(float("nan"), -2.0, -4.5, 0.1, -9.0, 0.01, 1)[1] == 3 and calls == [8, 1]
    quiet = k.Watchdog()
    flags = [quiet.step(0.5, -2.0, -4.5, 0.1, -9.0, 0.1, 0)[0] for _ in range(12)]
    assert flags[:9] == [0] * 9 and flags[9:] == [32] * 3
    far = k.Watchdog()
    assert [far.step(0.5, -2.0, -4.5, 0.01, 0.0, 0.01, 1)[0] & 16 for _ in range(4)] == [0, 0, 16, 0]
