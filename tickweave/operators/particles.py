"""Monte-Carlo state estimators: Rao-Blackwellised particle filters over many series at once.

A bank holds the clouds of a block of series as arrays of (series x particles), and a
step moves all series that have a tick, so that NumPy's cost per call is shared.
Regimes are sampled; log-volatility is a normal per particle. Random numbers are a
function of seed, key and tick (``counters``), so that results don't depend on which
series share a bank. ``Single`` makes a state machine of one series out of a bank.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

from tickweave.functions.fixed import MIXTURE_MEANS, MIXTURE_VARIANCES, MIXTURE_WEIGHTS
from tickweave.operators import kernels as k
from tickweave.operators.counters import Draws, stream_of

#: Speed of reversion, level and innovation deviation of log-volatility by regime.
REGIMES = ((0.05, -5.2, 0.08), (0.08, -4.6, 0.12), (0.12, -4.0, 0.2), (0.15, -3.4, 0.3))
_W, _M, _V = (np.array(x) for x in (MIXTURE_WEIGHTS, MIXTURE_MEANS, MIXTURE_VARIANCES))
#: Uses of random numbers within a tick.
REGIME, RESAMPLE, JITTER, LOOK, MUTATE, LAMBDA, DRAW, LEVEL, MOVE = 0, 1, 2, 3, 4, 8, 16, 24, 32


def generator(seed: int, key, bits=np.random.PCG64) -> np.random.Generator:
    return np.random.Generator(bits([seed, zlib.crc32(repr(key).encode())]))


def systematic(weights: np.ndarray, u: float) -> np.ndarray:
    """Ancestor indices from one uniform number."""
    n = len(weights)
    edges = np.cumsum(weights)
    return np.minimum(np.searchsorted(edges, (u + np.arange(n)) / n * edges[-1]), n - 1)


def systematic_rows(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Ancestors of every row of weights, each from one uniform number."""
    rows, n = weights.shape
    edges = np.cumsum(weights, axis=1)
    before = np.clip(np.ceil(edges * (n / edges[:, -1:]) - u[:, None]), 0, n).astype(np.int64)
    before[:, -1] = n
    return np.repeat(np.tile(np.arange(n), rows), np.diff(before, axis=1, prepend=0).ravel()).reshape(rows, n)


def sticky(count: int, stay: float) -> np.ndarray:
    return np.where(np.eye(count, dtype=bool), stay, (1 - stay) / (count - 1))


#: Particles that are collapsed at a time: their components stay in the cache, and below the size that the allocator maps anew.
CHUNK = 2048


def collapse(m, v, y, extra=None):
    """Mixture-Kalman update of normals by y = 2 l + noise: log likelihood, mean, variance and posterior share of the extra component.

    ``m`` and ``v`` have any shape, ``y`` one that broadcasts to it. ``extra`` is (share,
    variance) of an outlier component around the prediction. Components are the first
    axis, in single precision relative to the prediction.
    """
    m = np.asarray(m, float)
    if m.size > CHUNK and len(m) > 1:
        rows = max(1, CHUNK * len(m) // m.size)
        y = np.broadcast_to(y, m.shape if np.shape(y) == m.shape else (len(m), *np.shape(y)[1:]))
        parts = [_collapse(m[i : i + rows], v[i : i + rows], y[i : i + rows], extra) for i in range(0, len(m), rows)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _collapse(m, v, y, extra)


def _collapse(m, v, y, extra):
    w, shift, noise = _W, _M, _V
    if extra:
        w, shift, noise = np.append((1 - extra[0]) * _W, extra[0]), np.append(_M, 0.0), np.append(_V, min(max(extra[1], 12.0), 50.0))
    v = np.asarray(v, float)
    each = lambda x: x.astype(np.float32).reshape((-1,) + (1,) * m.ndim)
    v4, error = (4 * v).astype(np.float32), (y - 2 * m).astype(np.float32)
    s = each(noise) + v4
    e = error - each(shift)
    q = e * e
    q /= s
    least = q.min(0)
    q -= least
    q *= np.float32(-0.5)
    p = np.exp(q, out=q)
    p *= each(w)
    p /= np.sqrt(s)
    total = p.sum(0)
    p /= total
    half = (2 * v).astype(np.float32)
    np.divide(half, s, out=s)  # the gain
    e *= s  # how far a component moves the mean
    by = (p * e).sum(0)  # sums over the first axis are the same for any number of series
    s *= -half
    e *= e
    s += e
    s *= p
    variance = v + s.sum(0) - by * by
    lik = np.log(total.astype(float)) - 0.5 * least - 0.5 * math.log(2 * math.pi)
    return lik, m + by, np.maximum(variance, 1e-6).astype(float), p[-1] if extra else np.zeros(m.shape)


def geodesic_point(m1, v1, m2, v2, t):
    """Mean and variance at share t of the Fisher-Rao geodesic between normals, for arrays."""
    s1, s2, x1, x2 = np.sqrt(v1), np.sqrt(v2), m1 / math.sqrt(2), m2 / math.sqrt(2)
    straight = np.abs(x1 - x2) < 1e-9
    centre = ((x2 * x2 + s2 * s2) - (x1 * x1 + s1 * s1)) / np.where(straight, 1.0, 2 * (x2 - x1))
    radius = np.sqrt((x1 - centre) ** 2 + s1 * s1)
    a1, a2 = (np.log(np.tan(np.arctan2(s, x - centre) / 2)) for s, x in ((s1, x1), (s2, x2)))
    angle = 2 * np.arctan(np.exp(a1 + t * (a2 - a1)))
    mean, deviation = math.sqrt(2) * (centre + radius * np.cos(angle)), radius * np.sin(angle)
    return np.where(straight, m1, mean), np.where(straight, np.exp(np.log(s1) + t * (np.log(s2) - np.log(s1))), deviation) ** 2


def chi_loglik(y, level):
    """Log density of a log-square return given log-volatility."""
    d = np.minimum(y - 2 * level, 50.0)
    return 0.5 * (d - np.exp(d) - math.log(2 * math.pi))


class Bank:
    """Particle filters of many series; regime-switching stochastic volatility.

    Options: ``outlier`` (share, variance) adds a robust component; ``nu`` Student-t
    noise by an auxiliary scale; ``learn`` updates levels and deviations per particle
    and regime by conjugate statistics; ``lookahead`` (surprise, blend) weighs the
    ancestors of series whose last surprise was that large by their likelihood of the
    next tick under three offsets, to the power of the blend; ``moves`` attempts of a
    Metropolis jitter after resampling, in the bounds of each particle's regime;
    ``mutation``: chance that a particle of a crowded regime goes to one that has fewer
    than ``diversity``, along the Fisher-Rao geodesic.
    """

    OUTPUTS = "log_vol double, vol double, variance double, regime int, p array<double>, ess double, entropy double, surprise double, outlier double, resampled boolean, mu array<double>"

    def __init__(self, n=256, regimes=REGIMES, stay=0.95, seed=1, outlier=None, nu=None, learn=False, lookahead=None, diversity=2, mutation=0.001, moves=0, forget=0.998):
        self.n, self.k, self.seed = n, len(regimes), seed
        self.theta, self.level, self.sigma = (np.array(x, float) for x in zip(*regimes))
        self.stay, self.outlier, self.nu, self.learn, self.lookahead = stay, outlier, nu, learn, lookahead
        self.diversity, self.mutation, self.moves, self.forget = diversity, mutation, moves, forget
        self.bounds = np.concatenate([[-np.inf], (np.sort(self.level)[:-1] + np.sort(self.level)[1:]) / 2, [np.inf]])
        self.place = np.argsort(np.argsort(self.level))
        self.a: dict[str, np.ndarray] = {}
        self.count = 0

    def fresh(self, size: int) -> dict[str, np.ndarray]:
        """State of new series; the first axis is the series."""
        regime = np.tile(np.arange(self.n) % self.k, (size, 1))
        out = {
            "regime": regime, "m": self.level[regime], "v": np.full((size, self.n), 0.1), "logw": np.zeros((size, self.n)), "tick": np.zeros(size, np.int64),
            "t": np.tile(sticky(self.k, self.stay), (size, 1, 1)), "boost": np.ones(size), "last_surprise": np.zeros(size), "scale": np.ones(size), "accept": np.full(size, 0.5),
        }
        if self.learn:
            mu, s2 = np.tile(self.level, (size, self.n, 1)), np.tile(self.sigma**2, (size, self.n, 1))
            out |= {"mu": mu, "s2": s2, "nm": mu.copy(), "nk": np.full(mu.shape, 10.0), "na": np.full(mu.shape, 6.0), "nb": 5.0 * s2, "forget": np.full(size, self.forget)}
        return out

    def add(self, keys) -> np.ndarray:
        """Room for new series; returns their places."""
        new = self.fresh(len(keys)) | {"stream": np.array([stream_of(self.seed, key) for key in keys], np.uint64)}
        self.a = {name: np.concatenate([self.a[name], x]) if self.a else x for name, x in new.items()}
        self.count += len(keys)
        return np.arange(self.count - len(keys), self.count)

    # Parts of a step; ``c`` is the state of the series that have a tick.

    def weights(self, c) -> np.ndarray:
        w = np.exp(c["logw"] - c["logw"].max(1, keepdims=True))
        return w / w.sum(1, keepdims=True)

    def _take(self, c, rows, ancestors) -> None:
        for name in ("regime", "m", "v", "mu", "s2", "nm", "nk", "na", "nb"):
            if name in c:
                x = c[name][rows]
                c[name][rows] = np.take_along_axis(x, ancestors if x.ndim == 2 else ancestors[:, :, None], 1)

    def _own(self, c, name, fixed):
        """A parameter of each particle's regime."""
        return self._at(c, name) if self.learn else np.take(fixed, c["regime"])

    def _at(self, c, name):
        return np.take(c[name].reshape(-1), c["regime"] + self.k * np.arange(c["regime"].size).reshape(c["regime"].shape))

    def _ahead(self, c, d: Draws, y) -> None:
        surprise, blend = self.lookahead
        rows = np.flatnonzero(c["last_surprise"] > surprise)
        if len(rows):
            s = {name: x[rows] for name, x in c.items()}
            th = self.theta[s["regime"]]
            m = (1 - th) * s["m"] + th * self._own(s, "mu", self.level)
            sd = np.sqrt((1 - th) ** 2 * s["v"] + self._own(s, "s2", self.sigma**2))
            best = np.max([collapse(m + x * sd, np.full(m.shape, 1e-3), y[rows, None])[0] for x in (-1, 0, 1)], axis=0) * blend
            ancestors = systematic_rows(self.weights(s) * np.exp(best - best.max(1, keepdims=True)), d.one(LOOK, rows))
            self._take(c, rows, ancestors)
            c["logw"][rows] = -np.take_along_axis(best, ancestors, 1)

    def predict(self, c, d: Draws) -> None:
        u, edges = d.uniform(REGIME), np.cumsum(c["t"], axis=2).astype(np.float32)
        row = c["regime"] + self.k * np.arange(len(u))[:, None]
        new = np.zeros(u.shape, np.int64)
        for j in range(self.k - 1):
            new += u > np.take(edges[:, :, j].reshape(-1), row)
        c["regime"] = new
        th = np.take(self.theta, new)
        c["before"] = c["m"]
        c["m"] = (1 - th) * c["m"] + th * self._own(c, "mu", self.level)
        c["v"] = (1 - th) ** 2 * c["v"] + self._own(c, "s2", self.sigma**2) * c["boost"][:, None]

    def _likelihood(self, c, d: Draws, y):
        if self.nu:
            scale = 0.5 * (self.nu + np.exp(np.clip(y[:, None] - 2 * c["m"], -20, 20)))
            y = y[:, None] + np.log(np.maximum(d.gamma((self.nu + 1) / 2, LAMBDA) / scale, 1e-10))
        else:
            y = y[:, None]
        return collapse(c["m"], c["v"], y, self.outlier)

    def _learn(self, c, d: Draws) -> None:
        """Conjugate update of each particle's present regime, then a draw of its level and deviation."""
        at, w = c["regime"][:, :, None], self.theta[c["regime"]]
        z = c["m"] - (1 - w) * c["before"]
        mean, kappa, alpha, beta = (self._at(c, x) for x in ("nm", "nk", "na", "nb"))
        forget = c["forget"][:, None]
        kappa, alpha, beta = np.maximum(forget * kappa, 5.0), 3 + forget * np.maximum(alpha - 3, 0), forget * beta
        new = kappa + w * w
        beta = beta + 0.5 * (z / w - mean) ** 2 / (1 / kappa + 1 / (w * w))
        mean, alpha = (kappa * mean + z * w) / new, alpha + 0.5
        draw = np.clip(beta / d.gamma(alpha, DRAW), 1e-4, 1.0)
        level = np.clip(mean + np.sqrt(draw / new) * d.normal(LEVEL), -9.0, 1.0)
        for x, value in zip(("nm", "nk", "na", "nb", "s2", "mu"), (mean, new, alpha, beta, draw, level)):
            np.put_along_axis(c[x], at, value[:, :, None], 2)

    def bandwidth(self, m: np.ndarray) -> np.ndarray:
        """Silverman's, for each row."""
        ordered = np.sort(m, axis=1)
        spread = np.minimum(m.std(1), np.maximum((ordered[:, 3 * self.n // 4] - ordered[:, self.n // 4]) / 1.34, 1e-6))
        return np.clip(0.9 * spread * self.n**-0.2, 0.001, 0.5)

    def _regularise(self, c, rows, d: Draws, y) -> None:
        """Kernel jitter: means move, variances widen by as much; then moves and mutation."""
        h, eps = self.bandwidth(c["m"][rows])[:, None], d.normal(JITTER, rows)
        c["m"][rows] += 0.1 * h * eps
        c["v"][rows] += (0.1 * h) ** 2 * np.abs(eps)
        if self.moves:
            self._move(c, rows, d, y, h)
        if self.mutation:
            self._mutate(c, rows, d)

    def _move(self, c, rows, d: Draws, y, h) -> None:
        """Up to ``moves`` Metropolis attempts for each particle; a series' step is adapted so that about half of them are taken."""
        m, place = c["m"][rows], self.place[c["regime"][rows]]
        now, done = chi_loglik(y[rows, None], m), np.zeros(m.shape, bool)
        for attempt in range(self.moves):
            new = m + c["scale"][rows, None] * h * d.normal(MOVE + 2 * attempt, rows)
            value = chi_loglik(y[rows, None], new)
            ok = ~done & (new >= self.bounds[place]) & (new < self.bounds[place + 1]) & (np.log(d.uniform(MOVE + 2 * attempt + 1, rows)) < value - now)
            m, now, done = np.where(ok, new, m), np.where(ok, value, now), done | ok
        c["m"][rows] = m
        rate = c["accept"][rows] = 0.9 * c["accept"][rows] + 0.1 * done.mean(1)
        c["scale"][rows] = np.clip(c["scale"][rows] * np.where(rate > 0.6, 1.05, np.where(rate < 0.4, 0.95, 1.0)), 0.1, 5.0)

    def _mutate(self, c, rows, d: Draws) -> None:
        counts = np.stack([(c["regime"][rows] == j).sum(1) for j in range(self.k)], axis=1)
        for i in np.flatnonzero((counts < self.diversity).any(1)):
            row = rows[i]
            chosen = np.flatnonzero(d.uniform(MUTATE, np.array([row]))[0] < self.mutation)
            for particle in chosen:
                old = c["regime"][row, particle]
                short = np.flatnonzero(counts[i] < self.diversity)
                if counts[i, old] > 2 * self.diversity and len(short):
                    new = short[0]
                    counts[i, old], counts[i, new] = counts[i, old] - 1, counts[i, new] + 1
                    level = c["mu"][row, particle, new] if self.learn else self.level[new]
                    own = self.sigma[new] ** 2 / (1 - (1 - self.theta[new]) ** 2)
                    m, v = c["m"][row, particle], c["v"][row, particle]
                    c["m"][row, particle], c["v"][row, particle] = geodesic_point(m, v, level, own, v / (v + own))
                    c["regime"][row, particle] = new

    def _reweigh(self, c, lik, w):
        """Exponent of the likelihood in the weights, a number for each series; hook of the tempered step."""
        return 1.0

    def _learnt(self, c, out) -> None:
        """Hook after the outputs and before learning."""

    def step(self, at, y):
        """Outputs (arrays over ``at``) of a tick of the series at these places."""
        whole = len(at) == self.count
        c = {name: x if whole else x[at] for name, x in self.a.items()}
        y = np.asarray(y, float)
        d = Draws(c["stream"], c["tick"], self.n)
        c["tick"] = c["tick"] + 1
        out = self._tick(c, d, y)
        c.pop("before", None)
        if whole:
            self.a = c
        else:
            for name, x in c.items():
                self.a[name][at] = x
        return out

    def _tick(self, c, d: Draws, y):
        if self.lookahead:
            self._ahead(c, d, y)
        self.predict(c, d)
        lik, c["m"], c["v"], out = self._likelihood(c, d, y)
        return self._finish(c, d, y, lik, out)

    def _finish(self, c, d: Draws, y, lik, out):
        before = self.weights(c)
        outlier = (before * out).sum(1)
        top = lik.max(1)
        surprise = -(top + np.log(np.maximum((before * np.exp(lik - top[:, None])).sum(1), 1e-300)))
        c["logw"] = c["logw"] + lik * self._reweigh(c, lik, before)
        c["logw"] -= c["logw"].max(1, keepdims=True)
        w = self.weights(c)
        p = np.bincount((c["regime"] + self.k * np.arange(len(y))[:, None]).ravel(), w.ravel(), self.k * len(y)).reshape(-1, self.k)
        mean = (w * c["m"]).sum(1)
        variance = (w * (c["v"] + (c["m"] - mean[:, None]) ** 2)).sum(1)
        vol = (w * np.exp(c["m"] + 0.5 * c["v"])).sum(1)
        ess = 1 / (w * w).sum(1)
        entropy = -(p * np.log(np.maximum(p, 1e-10))).sum(1)
        c["last_surprise"] = surprise.copy()  # the state is written in place, what is returned must not be
        regime = p.argmax(1)
        self._learnt(c, {"surprise": surprise, "outlier": outlier, "regime": regime})
        if self.learn:
            self._learn(c, d)
            learned = (w[:, :, None] * c["mu"]).sum(1)
        else:
            learned = np.tile(self.level, (len(y), 1))
        resampled = ess <= self.n / 2
        rows = np.flatnonzero(resampled)
        if len(rows):
            self._take(c, rows, systematic_rows(w[rows], d.one(RESAMPLE, rows)))
            c["logw"][rows] = 0.0
            self._regularise(c, rows, d, y)
        return mean, vol, variance, regime, p, ess, entropy, surprise, outlier, resampled, learned


class Extended(Bank):
    """The composed step: excitation moves transitions upwards, a robust update is tempered by its divergence, surprise sets the forgetting of what is learnt, and transitions are learnt from the filtered regimes.

    Inputs: y and the return. Every ``rebuild`` ticks the transition rows are made anew
    from decayed counts of the most likely regimes.
    """

    OUTPUTS = "log_vol double, vol double, regime int, ess double, surprise double, outlier double, intensity double, temper double, factor double, broke boolean, stay double, mu array<double>"

    def __init__(self, n=256, rebuild=100, decay=0.995, own=50.0, wait=500, hawkes=None, **options):
        super().__init__(n, **({"outlier": (0.02, 30.0), "learn": True, "moves": 3} | options))
        self.rebuild, self.decay, self.own, self.wait, self.hawkes = rebuild, decay, own, wait, hawkes or {}
        self.machines: list = []

    def fresh(self, size):
        self.machines += [(k.Hawkes(**self.hawkes), k.KlTempering(self.n, self.wait), k.AdaptiveForgetting()) for _ in range(size)]
        counts = np.where(np.eye(self.k, dtype=bool), self.own, 1.0)
        return super().fresh(size) | {"base": np.tile(sticky(self.k, self.stay), (size, 1, 1)), "counts": np.tile(counts, (size, 1, 1)), "state": np.full(size, -1), "place": np.arange(self.count, self.count + size)}

    def step(self, at, y, r):
        self.r = np.asarray(r, float)
        return super().step(at, y)

    def _tick(self, c, d, y):
        rows = np.arange(len(y))
        known = np.maximum(c["state"], 0)
        self.now = [self.machines[i] for i in c["place"]]
        for i in rows:  # what the ticks before have excited
            hawkes = self.now[i][0]
            c["t"][i] = k.hawkes_boost(c["base"][i].tolist(), hawkes.now, hawkes.mu)
        out = super()._tick(c, d, y)
        intensity = np.array([m[0].step(x, s)[0] for m, x, s in zip(self.now, self.r, known)])
        regime = out[3]
        seen = np.flatnonzero(c["state"] >= 0)
        c["counts"][seen] *= self.decay
        c["counts"][seen, c["state"][seen], regime[seen]] += 1
        c["state"] = regime.copy()
        due = np.flatnonzero(c["tick"] % self.rebuild == 0)
        rows_of = c["counts"][due] + 0.1
        c["base"][due] = rows_of / rows_of.sum(2, keepdims=True)
        stay = c["base"][rows, regime, regime]
        return out[0], out[1], regime, out[5], out[7], out[8], intensity, self.temper, self.factor, self.broke, stay, out[10]

    def _reweigh(self, c, lik, w):
        """Temper weights whose divergence from the ones before is too large."""
        new = w * np.exp(lik - lik.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        divergence = (new * np.log(np.maximum(new, 1e-300) / np.maximum(w, 1e-300))).sum(1)
        self.temper = np.array([m[1].step(float(x))[0] for m, x in zip(self.now, divergence)])
        return self.temper[:, None]

    def _learnt(self, c, out):
        found = [m[2].step(float(s), float(o), int(r)) for m, s, o, r in zip(self.now, out["surprise"], out["outlier"], out["regime"])]
        self.factor, self.broke = np.array([x[0] for x in found]), np.array([x[2] for x in found])
        c["forget"] = self.factor.copy()


class MultiModelBank:
    """Three particle filters (calm, trend, crisis) of each series, weighted by likelihood; a change point widens all of them.

    ``step`` takes y and the return; the return feeds a run-length detector whose alarm
    injects a shock: for some ticks transitions are uniform and innovations larger, by a
    factor of its own, so that what is learnt meanwhile stays when the saved transitions
    come back. No further shock is injected before the cooldown ends.
    """

    OUTPUTS = "log_vol double, vol double, vol_std double, w array<double>, dominant int, ess double, outlier double, shock boolean"
    LEVELS = ((0.04, -5.2, 0.06), (0.08, -4.5, 0.12), (0.15, -3.6, 0.3))

    def __init__(self, n=128, seed=1, shocks=True, gain=3.0, hold=5, cooldown=20):
        nus = (None, 6.0, 3.0)
        self.models = [Bank(n, ((a, b - 0.3, s), (a, b + 0.3, s)), 0.95, seed + 7 * j, (0.02, 30.0), nus[j], True) for j, (a, b, s) in enumerate(self.LEVELS)]
        self.t, self.shocks, self.gain, self.hold, self.cooldown = sticky(3, 0.96), shocks, gain, hold, cooldown
        self.w, self.detectors, self.left, self.wait, self.saved = np.empty((0, 3)), [], [], [], []

    def add(self, keys):
        places = [m.add(keys) for m in self.models][0]
        self.w = np.concatenate([self.w, np.full((len(keys), 3), 1 / 3)])
        self.detectors += [k.Bocpd(("constant", 120.0)) if self.shocks else None for _ in keys]
        self.left, self.wait, self.saved = self.left + [0] * len(keys), self.wait + [0] * len(keys), self.saved + [None] * len(keys)
        return places

    def inject(self, i: int) -> None:
        self.saved[i] = [m.a["t"][i].copy() for m in self.models]
        for m in self.models:
            m.a["t"][i] = 1 / m.k
            m.a["boost"][i] = self.gain**2
        self.left[i], self.wait[i] = self.hold, self.cooldown

    def restore(self, i: int) -> None:
        for m, t in zip(self.models, self.saved[i]):
            m.a["t"][i], m.a["boost"][i] = t, 1.0
        self.saved[i] = None

    def _alarm(self, i: int, r: float) -> bool:
        run, change, *_ = self.detectors[i].step(r)
        self.wait[i] = max(0, self.wait[i] - 1)
        if self.left[i]:
            self.left[i] -= 1
            if not self.left[i]:
                self.restore(i)
        elif change > 0.5 and run < 5 and not self.wait[i] and self.detectors[i].seen_enough():
            self.inject(i)
            return True
        return False

    def step(self, at, y, r):
        shock = np.array([self.shocks and self._alarm(int(i), float(x)) for i, x in zip(at, r)])
        outs = [m.step(at, y) for m in self.models]
        pick = lambda j: np.stack([o[j] for o in outs], axis=1)
        w = np.maximum((self.w[at][:, :, None] * self.t).sum(1), 1e-6) * np.exp(-(pick(7) - pick(7).min(1, keepdims=True)))
        w /= w.sum(1, keepdims=True)
        self.w[at] = w
        vols = pick(1)
        mean = (w * vols).sum(1)
        std = np.sqrt((w * (vols - mean[:, None]) ** 2).sum(1) + (w * vols**2 * pick(2)).sum(1))
        return (w * pick(0)).sum(1), mean, std, w, w.argmax(1), pick(5).min(1), (w * pick(8)).sum(1), shock


class ShockedBank(Bank):
    """A filter whose particles teleport when a tick's surprise exceeds a limit.

    Instead of weighing the cloud by such a tick, its particles are resampled and moved by
    random-walk Metropolis steps whose target is the tick's likelihood and the spread of
    the regime; a particle takes the regime in whose bounds it ends. The tick is used
    once, and the variances become those of one innovation.
    """

    OUTPUTS = "log_vol double, surprise double, moved double"

    def __init__(self, n=128, limit=6.0, steps=5, **options):
        super().__init__(n, **options)
        self.limit, self.steps_, self.order = limit, steps, np.argsort(self.level)

    def _tick(self, c, d, y):
        self.predict(c, d)
        lik, m, v, out = self._likelihood(c, d, y)
        w = self.weights(c)
        top = lik.max(1)
        surprise = -(top + np.log(np.maximum((w * np.exp(lik - top[:, None])).sum(1), 1e-300)))
        rows, moved = np.flatnonzero(surprise > self.limit), np.zeros(len(y))
        calm = np.setdiff1d(np.arange(len(y)), rows)
        c["m"][calm], c["v"][calm] = m[calm], v[calm]
        if len(rows):
            self._take(c, rows, systematic_rows(w[rows], d.one(LOOK, rows)))
            c["logw"][rows], lik[rows] = 0.0, 0.0
            moved[rows] = self.teleport(c, rows, d, y)
        found = self._finish(c, d, y, lik, out)
        return found[0], surprise, moved

    def teleport(self, c, rows, d: Draws, y) -> np.ndarray:
        """Share of the moves that are taken, by series."""
        m, regime, accepted = c["m"][rows], c["regime"][rows], 0.0
        level, spread = self.level[regime], np.sqrt(self.sigma**2 / (1 - (1 - self.theta) ** 2))
        target = lambda x, r: chi_loglik(y[rows, None], x) - 0.5 * ((x - self.level[r]) / spread[r]) ** 2 - np.log(spread[r])
        scale, now = np.maximum(np.sqrt(c["v"][rows]), 0.5 * np.abs(0.5 * (y[rows, None] + 1.27) - level)), target(m, regime)
        for i in range(self.steps_):
            new = m + scale * d.normal(MOVE + 2 * i, rows)
            to = self.order[np.searchsorted(self.bounds[1:-1], new, "right")]
            value = target(new, to)
            ok = np.log(d.uniform(MOVE + 2 * i + 1, rows)) < value - now
            m, regime, now = np.where(ok, new, m), np.where(ok, to, regime), np.where(ok, value, now)
            accepted = accepted + ok.mean(1)
        c["m"][rows], c["regime"][rows], c["v"][rows] = m, regime, self.sigma[regime] ** 2
        return accepted / self.steps_


class CatchUpBank(Bank):
    """Filters, but a null observation is a tick that was missed: the cloud is carried through it."""

    OUTPUTS = "log_vol double, seen boolean"

    def _tick(self, c, d, y):
        self.predict(c, d)
        seen = ~np.isnan(y)
        lik, m, v, out = self._likelihood(c, d, np.where(seen, y, 0.0))
        c["m"], c["v"] = np.where(seen[:, None], m, c["m"]), np.where(seen[:, None], v, c["v"])
        found = self._finish(c, d, y, np.where(seen[:, None], lik, 0.0), out)
        return found[0], seen


class Single:
    """A state machine of one series out of a bank; ``step`` gives a tuple of plain values."""

    def __init__(self, bank, key=()):
        self.bank, self.at = bank, bank.add([key])

    def step(self, *values):
        return tuple(x[0].tolist() for x in self.bank.step(self.at, *(np.array([v], float) for v in values)))


class ParticleFilter(Single):
    """The filter of one series; options as in ``Bank``."""

    OUTPUTS = Bank.OUTPUTS

    def __init__(self, key=(), **options):
        super().__init__(Bank(**options), key)
        self.n = self.bank.n

    def __getattr__(self, name):
        """The cloud and parameters of the one series."""
        state = self.__dict__["bank"].a
        if name in state:
            return state[name][0]
        raise AttributeError(name)


class MultiModel(Single):
    OUTPUTS = MultiModelBank.OUTPUTS

    def __init__(self, key=(), **options):
        super().__init__(MultiModelBank(**options), key)


class SmoothedLearner(ParticleFilter):
    """A filter whose learning waits ``lag`` ticks and uses the smoothed path of the window.

    The ring holds the collapsed normals of the last ticks; a backward pass refines
    them before the oldest one updates the statistics of its regime. A collapse of
    the weights flushes the ring: what it holds is learnt at once, unsmoothed.
    """

    OUTPUTS = "log_vol double, smooth double, regime int, mu array<double>, sigma array<double>"

    def __init__(self, key=(), n=128, lag=20, **options):
        super().__init__(key, n=n, **options)
        self.lag, self.window = lag, []
        self.nig = [[m, 10.0, 6.0, 5.0 * s * s] for m, s in zip(self.bank.level, self.bank.sigma)]

    def _update(self, r, old, new) -> None:
        """Statistics of regime r by the move from one level to the next."""
        w, (m, kappa, a, b) = float(self.bank.theta[r]), self.nig[r]
        z = new - (1 - w) * old
        kappa, b, a = max(self.bank.forget * kappa, 5.0), self.bank.forget * b, 3 + self.bank.forget * max(a - 3, 0.0)
        b += 0.5 * (z / w - m) ** 2 / (1 / kappa + 1 / (w * w))
        self.nig[r] = [(kappa * m + z * w) / (kappa + w * w), kappa + w * w, a + 0.5, b]
        self.bank.level[r] = self.nig[r][0]

    def step(self, y: float):
        out = super().step(y)
        mean, variance, regime, ess = out[0], out[2], out[3], out[5]
        self.window.append((mean, variance, regime))
        smooth = mean
        if ess < 0.02 * self.n:
            for old, new in zip(self.window, self.window[1:]):
                self._update(new[2], old[0], new[0])
            self.window = self.window[-1:]
        elif len(self.window) > self.lag:
            s = self.window[-1][0]
            for t in range(len(self.window) - 2, -1, -1):
                m, v, _ = self.window[t]
                r = self.window[t + 1][2]
                th = self.bank.theta[r]
                gain = (1 - th) * v / ((1 - th) ** 2 * v + self.bank.sigma[r] ** 2)
                after, s = s, m + gain * (s - (1 - th) * m - th * self.nig[r][0])
            smooth = float(s)
            self._update(self.window[1][2], s, after)
            self.window.pop(0)
        return mean, smooth, regime, [float(x[0]) for x in self.nig], [math.sqrt(x[3] / (x[2] - 1)) for x in self.nig]
