"""Offline samplers of a series: smoothing, particle MCMC, nonparametric regimes.

Each class is a reducer for ``ordered_reduce``: ``push`` keeps at most ``window``
ticks (the oldest go first), ``finish`` runs the sampler and returns its rows.
``Consecutive`` covers a whole series by windows one after the other; ``Pmmh`` without
a window reads the whole series. More chains are more keys, so they run on different
tasks.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from tickweave.operators.particles import _M, _V, _W, REGIMES, ParticleFilter, generator, sticky, systematic
from tickweave.operators.spool import Spool

WINDOW = 512


def loglik(y: float, level: np.ndarray) -> np.ndarray:
    """Mixture log density of y for log-volatilities of any shape."""
    d = y - 2 * level[..., None] - _M
    p = np.log(_W) - 0.5 * np.log(2 * np.pi * _V) - d * d / (2 * _V)
    top = p.max(-1)
    return top + np.log(np.exp(p - top[..., None]).sum(-1))


class Windowed:
    """Ring of the last observations; the count of all that were pushed tells how stale a snapshot is."""

    def __init__(self, key=(), seed=1, window=WINDOW):
        self.rng, self.ring, self.pushed = generator(seed, key), deque(maxlen=window), 0

    def push(self, y):
        self.ring.append(y)
        self.pushed += 1

    @property
    def y(self) -> np.ndarray:
        return np.array(self.ring)


class Consecutive:
    """A sampler of its own for each of the consecutive windows of a series, so that every tick is in one.

    A window is run once ``least`` ticks more than it holds are there; so the last one
    has from ``least`` to ``window + least - 1`` ticks, and only series with fewer
    than ``least`` in all give no rows. Rows begin with the window's first tick.
    """

    def __init__(self, key=(), sampler=None, window=WINDOW, least=20, **options):
        self.key, self.make, self.window, self.least, self.options = tuple(key), sampler, window, least, options
        self.ticks, self.start = [], 0

    def push(self, y):
        self.ticks.append(y)
        if len(self.ticks) == self.window + self.least:
            return self._run(self.window)

    def finish(self):
        return self._run(len(self.ticks))

    def _run(self, size):
        s = self.make((*self.key, self.start) if self.start else self.key, window=size, **self.options)
        s.pushed = self.start
        for y in self.ticks[:size]:
            s.push(y)
        out = [(self.start, *row) for row in s.finish()]
        self.ticks, self.start = self.ticks[size:], self.start + size
        return out


def _blocks(y, size: int = 512):
    """Short arrays of a spool or sequence, in order."""
    for part in y.blocks() if isinstance(y, Spool) else (np.asarray(y),):
        for at in range(0, len(part), size):
            yield part[at : at + size]


class Tape:
    """Observations of a block of series, longest first, as chunks of (ticks x series); read as often as needed.

    Chunks of short series are held as arrays; beyond ``HELD`` numbers every pass reads the series (spools or arrays) again.
    """

    HELD, TICKS = 1 << 22, 64

    def __init__(self, series):
        self.series, self.sizes = series, np.array([len(y) for y in series], np.int64)
        self.held = list(self._read(np.arange(len(series)))) if self.sizes.sum() <= self.HELD else None

    def _read(self, columns):
        parts, sizes = [_blocks(self.series[i], self.TICKS) for i in columns], self.sizes[columns]
        for at in range(0, int(sizes.max(initial=0)), self.TICKS):
            found = [next(p) for p, size in zip(parts, sizes) if size > at]
            out = np.zeros((len(found[0]), len(found)), np.float32)
            for j, x in enumerate(found):
                out[: len(x), j] = x
            yield out

    def chunks(self, columns):
        """Chunks of some series: ascending columns, which may repeat; each has those that aren't over, and nothing past the first of them."""
        once, where = np.unique(columns, return_inverse=True)
        most = int(self.sizes[once].max(initial=0))
        for i, chunk in enumerate(self._read(once) if self.held is None else self.held[: -(-most // self.TICKS)]):
            place = where if self.held is None else columns
            yield chunk[: most - i * self.TICKS, place[: np.searchsorted(place, chunk.shape[1])]]


#: Chains whose particles are moved by one call, so that the arrays stay in the cache.
CHAINS = 192
#: Share of the particles; they are resampled where their effective number is smaller.
RESAMPLE = 0.3


class _Shocks:
    """Adds normals to particles (4 x chains x quarter): pairs by Box and Muller from 32 bits a number, and their opposites.

    Every number is normal by itself, so sums over particles keep their expectation. Each
    chain's bits come from a generator of its own.
    """

    def __init__(self, rngs, quarter):
        self.rngs, self.quarter, self.bits = rngs, quarter, np.empty((2, Tape.TICKS, len(rngs), quarter), np.int32)
        self.room = np.empty((4, len(rngs), quarter), np.float32)

    def draw(self, ticks) -> None:
        """Bits for so many ticks of the first chains."""
        for j, k in enumerate(ticks.tolist()):
            self.bits[:, :k, j] = self.rngs[j].bit_generator.random_raw(k * self.quarter).view(np.int32).reshape(2, k, self.quarter)

    def add(self, x, t, spread) -> None:
        """Normals of variance ``-spread / 2``, from the t-th bits."""
        radius, turn, a, b = self.room[:, : x.shape[1]]
        bits = self.bits[:, t, : x.shape[1]]
        np.copyto(radius, bits[0].view(np.uint32), casting="unsafe")
        radius += np.float32(0.5)
        radius *= np.float32(2.0**-32)
        np.log(radius, out=radius)
        radius *= spread
        np.sqrt(radius, out=radius)
        np.copyto(turn, bits[1], casting="unsafe")
        turn *= np.float32(math.pi / 2**31)
        np.cos(turn, out=a)
        a *= radius
        np.sin(turn, out=b)
        b *= radius
        x[0] += a
        x[1] += b
        x[2] -= a
        x[3] -= b


def _bootstrap(tape: Tape, columns, phi, mu, sigma, n, rngs) -> np.ndarray:
    """Logs of estimated likelihoods of chains on ascending columns of a tape."""
    count, quarter = len(columns), -(-n // 4)
    n, sizes, total, at = 4 * quarter, tape.sizes[columns], np.zeros(count), 0
    wide = lambda v: np.repeat(np.asarray(v, np.float32)[:, None], quarter, axis=1)
    # x is minus twice what log-volatility differs from its level, so its shocks have deviation 2 sigma
    x, w, last, spread = np.zeros((4, count, quarter), np.float32), np.ones((4, count, quarter), np.float32), np.full(count, float(n)), -8 * np.square(sigma)
    room, lw_room, shocks, mu = np.empty_like(x), np.empty_like(x), _Shocks(rngs, quarter), np.asarray(mu, np.float32)
    shocks.draw(np.ones(count, int))
    shocks.add(x, 0, wide(spread / np.maximum(1 - np.square(phi), 1e-4)))
    spread, phi = wide(spread), wide(phi)
    for chunk in tape.chunks(columns):
        size, live = chunk.shape
        ticks, points = np.minimum(sizes[:live] - at, size), np.zeros((size, live, 1), np.float32)
        shocks.draw(ticks)
        for j, k in enumerate(ticks.tolist()):
            points[:k, j, 0] = rngs[j].random(k, dtype=np.float32)
        level = chunk - 2 * mu[:live]
        for t in range(size):
            m = live - int(np.searchsorted(ticks[::-1], t, "right"))  # chains that have this tick
            x, w, last, d, lw = x[:, :m], w[:, :m], last[:m], room[:, :m], lw_room[:, :m]
            if at + t:
                x *= phi[:m]
                shocks.add(x, t, spread[:m])
            np.add(x, wide(level[t, :m]), out=d)
            np.exp(d, out=lw)
            np.subtract(d, lw, out=lw)
            lw *= np.float32(0.5)
            np.exp(lw, out=d)
            d *= w
            s = d.sum(0).sum(1).astype(float)
            if not s.min() > 1e-25 * n:
                _rescue(np.flatnonzero(~(s > 1e-25 * n)), lw, w, d, s, total)
            total[:m] += np.log(s / last)
            room, w, last = w, d, s
            again = np.flatnonzero(s * s < RESAMPLE * n * np.vecdot(w, w).sum(0))
            if len(again):
                x[:, again] = _resampled(x[:, again], w[:, again], points[t, again])
                w[:, again], last[again] = 1, n
            if last.min() < 1e-6 * n:
                low = np.flatnonzero(last < 1e-6 * n)
                w[:, low] *= (n / last[low, None]).astype(np.float32)
                last[low] = n
        at += size
    return total - 0.5 * sizes * math.log(2 * math.pi)


def _rescue(rows, lw, w, d, s, total) -> None:
    """Weights of chains that are too small for single precision, relative to the largest; none at all is an impossible series."""
    top = lw[:, rows].max((0, 2))[:, None]
    d[:, rows] = w[:, rows] * np.exp(lw[:, rows] - np.where(np.isfinite(top), top, 0))
    s[rows] = d[:, rows].sum((0, 2))
    none = rows[~(s[rows] > 0)]
    total[rows] += top[:, 0]
    total[none], d[:, none], s[none] = -np.inf, 1, w.shape[0] * w.shape[2]


def _resampled(x, w, u) -> np.ndarray:
    """Particles of chains by systematic resampling, each from one uniform number."""
    m, n = x.shape[1], x.shape[0] * x.shape[2]
    edges = np.cumsum(w.transpose(1, 0, 2).reshape(m, n), axis=1)
    edges *= n / edges[:, -1:]
    edges -= u
    before = np.ceil(edges, out=edges).astype(np.int64)
    np.minimum(before, n, out=before)
    before[:, -1] = n
    before += np.arange(0, m * n, n)[:, None]
    ends = before.reshape(-1)
    ends[1:] -= ends[:-1].copy()
    return np.repeat(x.transpose(1, 0, 2).reshape(-1), ends).reshape(m, 4, -1).transpose(1, 0, 2)


def bootstrap_logliks(series, phi, mu, sigma, n, rngs) -> np.ndarray:
    """Particle estimates of the likelihoods of AR(1) log-volatilities, with the exact density of a log-square return.

    A row per chain: its observations (spool or array), parameters and generator. Chains
    are stepped together, longer ones go on alone; a chain draws the same numbers whatever
    it is stepped with. Particles go in fours (n is rounded up); they are resampled where
    their effective number is below ``RESAMPLE`` of them, and keep their weights elsewhere.
    """
    order, out = np.argsort([-len(y) for y in series], kind="stable"), np.empty(len(series))
    phi, mu, sigma = (np.asarray(x, float)[order] for x in (phi, mu, sigma))
    out[order] = _bootstrap(Tape([series[i] for i in order]), np.arange(len(order)), phi, mu, sigma, n, [rngs[i] for i in order])
    return out


_NODES, _SHARES = (x.astype(np.float32)[:, None] for x in np.polynomial.hermite_e.hermegauss(5))
_SHARES /= _SHARES.sum()


def gaussian_logliks(tape: Tape, columns, phi, mu, sigma) -> np.ndarray:
    """The same likelihoods with the filter's law taken as normal after every tick, its moments by quadrature: near, smooth and cheap."""
    phi, mu, sigma = (np.asarray(x, np.float32) for x in (phi, mu, sigma))
    sizes, total, at = tape.sizes[columns], np.zeros(len(columns)), 0
    m, v, noise = np.zeros(len(columns), np.float32), sigma * sigma / np.maximum(1 - phi * phi, np.float32(1e-4)), sigma * sigma
    for chunk in tape.chunks(columns):
        size, live = chunk.shape
        ticks, level = np.minimum(sizes[:live] - at, size), chunk - 2 * mu[:live]
        for t in range(size):
            k = live - int(np.searchsorted(ticks[::-1], t, "right"))
            m, v = m[:k], v[:k]
            if at + t:
                m, v = phi[:k] * m, phi[:k] ** 2 * v + noise[:k]
            sd = np.sqrt(v)
            d = _NODES * (-2 * sd)
            d += level[t, :k] - 2 * m
            np.minimum(d, np.float32(50.0), out=d)
            p = np.exp(d)
            np.subtract(d, p, out=p)
            p *= np.float32(0.5)
            top = p.max(0)
            p -= top
            np.exp(p, out=p)
            p *= _SHARES
            s = p.sum(0)
            total[:k] += top + np.log(s)
            p *= _NODES
            a = p.sum(0) / s
            p *= _NODES
            m = m + sd * a
            v = v * np.maximum(p.sum(0) / s - a * a, np.float32(0.01))
        at += size
    return total - 0.5 * sizes * math.log(2 * math.pi)


class PmmhBank:
    """Chains of particle marginal Metropolis-Hastings for (mu, sigma, phi) of many series at once; a reducer of blocks.

    Acceptance is delayed (Christen and Fox): a proposal is tried on the cheap likelihood first, and the
    particles decide on those that pass by what is left of the ratio, so that the chain
    keeps the same posterior whatever the cheap likelihood is.
    """

    OUTPUTS = "chain int, mu double, sigma double, phi double, mu_sd double, sigma_sd double, acceptance double, loglik double, ticks long"

    def __init__(self, chains=2, seed=1, particles=256, steps=300, burn=100, least=10):
        self.chains, self.seed, self.particles, self.steps, self.burn, self.least = chains, seed, particles, steps, burn, least

    @staticmethod
    def log_prior(x) -> np.ndarray:
        mu, log_sigma, z = x.T
        return -0.5 * ((mu + 4.5) / 1.5) ** 2 - 0.5 * ((log_sigma + 1.6) / 0.7) ** 2 - 0.5 * ((z - 2.0) / 0.8) ** 2

    @staticmethod
    def _natural(x):
        return np.tanh(x[:, 2] / 2), x[:, 0], np.exp(x[:, 1])

    def run(self, keys, series) -> list[tuple[int, tuple]]:
        """(place of the key, output row) of every chain of every series with enough ticks."""
        order = sorted((i for i, y in enumerate(series) if len(y) >= self.least), key=lambda i: -len(series[i]))
        if not order:
            return []
        tape, columns = Tape([series[i] for i in order]), np.repeat(np.arange(len(order)), self.chains)
        jobs = [(i, c) for i in order for c in range(self.chains)]
        rngs = [generator(self.seed, (*keys[i], c), np.random.SFC64) for i, c in jobs]  # the quickest
        moves = np.stack([r.standard_normal((self.steps, 3)) for r in rngs], 1) * np.array([0.2, 0.3, 0.4])
        luck = np.log(1 - np.stack([r.random((self.steps, 2)) for r in rngs], 1))

        def cheap_of(x):
            return gaussian_logliks(tape, columns, *self._natural(x)) + self.log_prior(x)

        def value_of(which, x):
            parts = np.array_split(np.arange(len(which)), -(-len(which) // CHAINS))
            found = [_bootstrap(tape, columns[which[p]], *self._natural(x[p]), self.particles, [rngs[j] for j in which[p]]) for p in parts]
            return np.concatenate(found) + self.log_prior(x)

        now = np.repeat([[(series[i].mean() + 1.27) / 2, math.log(0.2), 2.0] for i in order], self.chains, axis=0)
        cheap, value = cheap_of(now), value_of(np.arange(len(jobs)), now)
        widen, accepted, kept = np.ones(len(jobs)), np.zeros(len(jobs)), []
        for i in range(self.steps):
            new = now + widen[:, None] * moves[i]
            other, ok = cheap_of(new), np.zeros(len(jobs), bool)
            if len(tried := np.flatnonzero(luck[i, :, 0] < other - cheap)):
                found = value_of(tried, new[tried])
                with np.errstate(invalid="ignore"):  # twice impossible
                    ok[tried] = luck[i, tried, 1] < found - value[tried] - (other - cheap)[tried]
                value[tried] = np.where(ok[tried], found, value[tried])
            now, cheap = np.where(ok[:, None], new, now), np.where(ok, other, cheap)
            accepted += ok
            if i < self.burn:
                widen *= np.exp((ok - 0.25) / math.sqrt(i + 1))
            else:
                kept.append(np.column_stack([now[:, 0], np.exp(now[:, 1]), np.tanh(now[:, 2] / 2)]))
        k = np.array(kept)
        mean, sd = k.mean(0), k.std(0)
        return [(i, (c, *map(float, mean[j]), float(sd[j, 0]), float(sd[j, 1]), float(accepted[j] / self.steps), float(value[j]), len(series[i]))) for j, (i, c) in enumerate(jobs)]


class Pmmh(Windowed):
    """One chain of ``PmmhBank``; without a window it runs on the whole series, read again at every step."""

    OUTPUTS = PmmhBank.OUTPUTS.removeprefix("chain int, ")

    def __init__(self, key=(), seed=1, window=None, particles=256, steps=300, burn=100):
        super().__init__(key, seed, window)
        if window is None:
            self.ring = Spool()
        self.key, self.bank = key, PmmhBank(1, seed, particles, steps, burn)

    def finish(self):
        found = self.bank.run([self.key], [self.ring if isinstance(self.ring, Spool) else self.y])
        return [(*row[1:-1], self.pushed) for _, row in found]


class _Path:
    """Parameters and the particle system of conditional SMC over (regime, log-volatility)."""

    def __init__(self, y, rng, particles, regimes, stay):
        self.y, self.rng, self.n = y, rng, particles
        self.theta, self.mu, self.sigma = (np.array(x) for x in zip(*regimes))
        self.k, self.t = len(regimes), sticky(len(regimes), stay)
        self.path = None

    def sweep(self):
        """Forward pass with the reference path as the last particle and ancestor sampling; returns all particles."""
        n, size, rng = self.n, len(self.y), self.rng
        r, h, a, lw = (np.zeros((size, n), int), np.zeros((size, n)), np.zeros((size, n), int), np.zeros((size, n)))
        edges = np.cumsum(self.t, 1)
        for t in range(size):
            if t == 0:
                r[0] = rng.integers(0, self.k, n)
                h[0] = self.mu[r[0]] + self.sigma[r[0]] * rng.standard_normal(n) * 2
            else:
                w = np.exp(lw[t - 1] - lw[t - 1].max())
                w /= w.sum()
                a[t] = systematic(w, rng.random())
                r[t] = np.minimum((rng.random(n)[:, None] > edges[r[t - 1][a[t]]]).sum(1), self.k - 1)
                h[t] = (1 - self.theta[r[t]]) * h[t - 1][a[t]] + self.theta[r[t]] * self.mu[r[t]] + self.sigma[r[t]] * rng.standard_normal(n)
            if self.path is not None:
                r[t, -1], h[t, -1] = self.path[0][t], self.path[1][t]
                if t:
                    back = np.log(w + 1e-300) + self.log_move(r[t - 1], h[t - 1], r[t, -1], h[t, -1])
                    p = np.exp(back - back.max())
                    a[t, -1] = rng.choice(n, p=p / p.sum())
            lw[t] = loglik(self.y[t], h[t])
        return r, h, a, lw

    def log_move(self, r0, h0, r1, h1):
        d = h1 - (1 - self.theta[r1]) * h0 - self.theta[r1] * self.mu[r1]
        return np.log(self.t[r0, r1]) - np.log(self.sigma[r1]) - 0.5 * (d / self.sigma[r1]) ** 2

    def trace(self, r, h, a, lw):
        """One path by its ancestors."""
        w = np.exp(lw[-1] - lw[-1].max())
        j, size = self.rng.choice(self.n, p=w / w.sum()), len(self.y)
        rs, hs = np.zeros(size, int), np.zeros(size)
        for t in range(size - 1, -1, -1):
            rs[t], hs[t] = r[t, j], h[t, j]
            j = a[t, j] if t else j
        return rs, hs

    def smooth(self, r, h, lw, paths):
        """Backward-sampled paths: (paths x time) regimes and log-volatilities."""
        size, rng = len(self.y), self.rng
        rs, hs = np.zeros((paths, size), int), np.zeros((paths, size))
        w = np.exp(lw[-1] - lw[-1].max())
        j = rng.choice(self.n, paths, p=w / w.sum())
        rs[:, -1], hs[:, -1] = r[-1, j], h[-1, j]
        for t in range(size - 2, -1, -1):
            back = lw[t][None] + self.log_move(r[t][None], h[t][None], rs[:, t + 1][:, None], hs[:, t + 1][:, None])
            p = np.exp(back - back.max(1, keepdims=True)).cumsum(1)
            j = np.minimum((rng.random((paths, 1)) * p[:, -1:] > p).sum(1), self.n - 1)
            rs[:, t], hs[:, t] = r[t, j], h[t, j]
        return rs, hs


def counts_of(regimes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    np.add.at(out, (regimes[..., :-1].ravel(), regimes[..., 1:].ravel()), 1)
    return out


class Pgas(Windowed):
    """Particle Gibbs with ancestor sampling for regimes, levels, deviations, persistence and sticky transition rows.

    Sweeps go on, between three and ten, until the path's renewal rate reaches its
    target; a sampler whose rate is still below ``abort`` at the end is marked as stuck.
    The stickiness follows the ratio of observed to expected changes. ``cloud`` has the
    particles of the last tick after ``finish``.
    """

    OUTPUTS = "regime int, mu double, sigma double, stay double, share double, kappa double, renewal double, sweeps int, phi double, stuck boolean"

    def __init__(self, key=(), seed=1, window=192, particles=48, regimes=REGIMES[:3], sweeps=(3, 10), target=0.15, kappa=30.0, abort=0.1):
        super().__init__(key, seed, window)
        self.particles, self.regimes, self.sweeps, self.target, self.kappa, self.abort = particles, regimes, sweeps, target, kappa, abort
        self.cloud = None

    def finish(self):
        y = self.y
        if len(y) < 20:
            return []
        s = _Path(y, self.rng, self.particles, self.regimes, 0.95)
        renewal, theta = 0.0, 1.0
        for done in range(1, self.sweeps[1] + 1):
            old = s.path
            r, h, a, lw = s.sweep()
            s.path = s.trace(r, h, a, lw)
            renewal = 1.0 if old is None else float((s.path[1] != old[1]).mean())
            self._draw(s, s.path[0][None], s.path[1][None])
            self._draw_speed(s)
            counts = counts_of(s.path[0], s.k)
            expected = (1 - np.diag(s.t)) @ counts.sum(1)
            theta += 0.5 * ((counts.sum() - np.trace(counts)) / max(expected, 1e-6) - theta)
            self.kappa = float(np.clip(self.kappa * math.exp(-0.2 * math.log(np.clip(theta, 0.3, 3.0))), 1.0, 500.0))
            if done >= self.sweeps[0] and renewal >= self.target and old is not None:
                break
        share = np.bincount(s.path[0], minlength=s.k) / len(y)
        w = np.exp(lw[-1] - lw[-1].max())
        self.cloud, self.rows = (r[-1], h[-1], w / w.sum()), s.t
        return [(j, float(s.mu[j]), float(s.sigma[j]), float(s.t[j, j]), float(share[j]), self.kappa, renewal, done, float(1 - s.theta[j]), renewal < self.abort) for j in range(s.k)]

    def _draw_speed(self, s: _Path, step: float = 0.3) -> None:
        """A Metropolis move of each regime's speed of reversion, on the logit scale, given the path; flat in the speed."""
        r, h = s.path
        for j in range(s.k):
            here = r[1:] == j
            if here.sum() > 2:
                value = lambda th: float(-0.5 * (((h[1:] - (1 - th) * h[:-1] - th * s.mu[j])[here] / s.sigma[j]) ** 2).sum()) + math.log(th * (1 - th))  # noqa: E731, B023
                new = 1 / (1 + math.exp(-(math.log(s.theta[j] / (1 - s.theta[j])) + step * self.rng.standard_normal())))
                if 0.005 < new < 0.9 and math.log(self.rng.random()) < value(new) - value(s.theta[j]):
                    s.theta[j] = new

    def _draw(self, s: _Path, rs: np.ndarray, hs: np.ndarray) -> None:
        """Conjugate draws given paths; regimes stay sorted by level."""
        rng, paths = self.rng, len(rs)
        counts = counts_of(rs, s.k) / paths
        s.t = np.stack([rng.dirichlet(counts[i] + 1 + self.kappa * (np.arange(s.k) == i)) for i in range(s.k)])
        for j in range(s.k):
            here = rs[:, 1:] == j
            w = s.theta[j]
            z = ((hs[:, 1:] - (1 - w) * hs[:, :-1]) / w)[here]
            n = len(z) / paths
            prior_n, prior_mu = 5.0, self.regimes[j][1]
            mean = z.mean() if len(z) else prior_mu
            spread = w * w * ((z - mean) ** 2).sum() / paths if len(z) else 0.0
            alpha, beta = 3 + n / 2, 3 * self.regimes[j][2] ** 2 + 0.5 * spread + 0.5 * w * w * prior_n * n / (prior_n + n) * (mean - prior_mu) ** 2
            s.sigma[j] = math.sqrt(np.clip(beta / rng.gamma(alpha), 1e-4, 1.0))
            s.mu[j] = (prior_n * prior_mu + n * mean) / (prior_n + n) + s.sigma[j] / w / math.sqrt(prior_n + n) * rng.standard_normal()
        order = np.argsort(s.mu)
        s.mu, s.sigma, s.theta, s.t = s.mu[order], s.sigma[order], s.theta[order], s.t[order][:, order]
        if s.path is not None:
            s.path = (np.argsort(order)[s.path[0]], s.path[1])


class Paris(Pgas):
    """Particle smoother: mean and deviation of the smoothed log-volatility, regime and diversity of paths at every tick of the window."""

    OUTPUTS = "tick long, log_vol double, sd double, regime int, p_regime double, paths int"

    def __init__(self, key=(), seed=1, window=128, particles=64, paths=24, regimes=REGIMES[:3]):
        super().__init__(key, seed, window, particles, regimes)
        self.paths = paths

    def finish(self):
        y = self.y
        if len(y) < 5:
            return []
        s = _Path(y, self.rng, self.particles, self.regimes, 0.95)
        r, h, _, lw = s.sweep()
        rs, hs = s.smooth(r, h, lw, self.paths)
        first = self.pushed - len(y)
        unique = len({row.tobytes() for row in rs})
        out = []
        for t in range(len(y)):
            p = np.bincount(rs[:, t], minlength=s.k) / self.paths
            out.append((first + t, float(hs[:, t].mean()), float(hs[:, t].std()), int(p.argmax()), float(p.max()), unique))
        return out


class StickyHdp(Windowed):
    """Sticky hierarchical-Dirichlet hidden Markov model: the number of regimes is learnt.

    A sweep draws slices, opens states until no row's rest exceeds the smallest slice
    (no other bound), filters forward and samples backward over the open transitions,
    and draws rows, shared weights and levels; empty states go. Births and merges of
    states are proposed and accepted by the marginal likelihood of their ticks and the
    prior of partitions. ``blocked`` filters over all transitions at once; new states
    are then born by proposal only. The concentrations are drawn too.
    """

    OUTPUTS = "state int, level double, share double, stay double, n_states int, loglik double, gamma double, kappa double"

    def __init__(self, key=(), seed=1, window=160, sweeps=8, alpha=1.0, gamma=1.0, kappa=20.0, blocked=False):
        super().__init__(key, seed, window)
        self.sweeps, self.alpha, self.gamma, self.kappa, self.blocked = sweeps, alpha, gamma, kappa, blocked

    def finish(self):
        y, rng = self.y, self.rng
        if len(y) < 20:
            return []
        z = np.digitize(y, np.quantile(y, [1 / 3, 2 / 3]))
        z = np.unique(z, return_inverse=True)[1]
        level = np.array([self._level(y[z == j]) for j in range(z.max() + 1)])
        beta = rng.dirichlet(np.append(np.ones(len(level)), self.gamma))
        total = 0.0
        for _ in range(self.sweeps):
            k = len(level)
            rows = self._rows(z, beta, k)
            u = np.array([rng.random() * rows[z[t - 1], z[t]] if t else rng.random() / k for t in range(len(y))])
            while not self.blocked and rows[:, -1].max() > u[1:].min():  # open a state
                stick = rng.beta(1, self.gamma)
                beta = np.concatenate([beta[:-1], [beta[-1] * stick, beta[-1] * (1 - stick)]])
                part = rng.beta(np.maximum(self.alpha * beta[-2], 1e-3), np.maximum(self.alpha * beta[-1], 1e-3), size=k)
                rows = np.column_stack([rows[:, :-1], rows[:, -1] * part, rows[:, -1] * (1 - part)])
                level = np.append(level, -4.5 + rng.standard_normal())
                k += 1
                rows = np.vstack([rows, rng.dirichlet(self.alpha * beta + self.kappa * (np.arange(k + 1) == k - 1) + 1e-3)])
            open_to = rows[:, :k]
            like = np.stack([loglik(v, level) for v in y])
            f = np.zeros((len(y), k))
            total = 0.0
            for t in range(len(y)):
                move = np.full(k, 1 / k) if t == 0 else f[t - 1] @ (open_to if self.blocked else (open_to > u[t]))
                w = move * np.exp(like[t] - like[t].max())
                total += like[t].max() + math.log(max(float((move / max(move.sum(), 1e-300) * np.exp(like[t] - like[t].max())).sum()), 1e-300))
                f[t] = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
            z = np.zeros(len(y), int)
            for t in range(len(y) - 1, -1, -1):
                p = f[t] if t == len(y) - 1 else f[t] * (open_to[:, z[t + 1]] if self.blocked else open_to[:, z[t + 1]] > u[t + 1])
                p = p if p.sum() > 0 else f[t]
                z[t] = rng.choice(k, p=p / p.sum())
            z = self._birth_or_merge(np.unique(z, return_inverse=True)[1], y)
            level = np.array([self._level(y[z == j]) for j in range(z.max() + 1)])
            beta = self._shared(z, len(level))
        self.z, self.level = z, level
        k, counts, share = len(level), counts_of(z, len(level)), np.bincount(z, minlength=len(level)) / len(y)
        order = np.argsort(level)
        return [(i, float(level[j]), float(share[j]), float((counts[j, j] + self.kappa) / (counts[j].sum() + self.kappa + self.alpha)), k, total, float(self.gamma), float(self.kappa)) for i, j in enumerate(order)]

    def export(self, theta: float = 0.08, sigma: float = 0.12):
        """Regimes and transition rows for a filter, by level, after ``finish``."""
        order = np.argsort(self.level)
        counts = counts_of(np.argsort(order)[self.z], len(order)) + 0.5 + self.kappa * np.eye(len(order))
        return tuple((theta, float(self.level[j]), sigma) for j in order), counts / counts.sum(1, keepdims=True)

    def take_over(self, regimes, shares) -> None:
        """Begin from a filter's regimes: their levels and shares set the stickiness and the shared weights' concentration."""
        self.gamma = max(1.0, float(np.count_nonzero(np.asarray(shares) > 0.01)) / 2)

    def _rows(self, z, beta, k):
        counts = np.column_stack([counts_of(z, k), np.zeros(k)])
        return np.stack([self.rng.dirichlet(self.alpha * beta + counts[i] + self.kappa * (np.arange(k + 1) == i) + 1e-3) for i in range(k)])

    @staticmethod
    def _evidence(y) -> float:
        """Log marginal likelihood of ticks of one state: a normal level around -4.5 and the variance of a log-square."""
        x, v, prior = (np.asarray(y) + 1.27) / 2, 4.93 / 4, 4.93 / 2
        n, d = len(x), x + 4.5
        return -0.5 * (n * math.log(2 * math.pi * v) + math.log1p(n * prior / v) + (d @ d - d.sum() ** 2 * prior / (v + n * prior)) / v)

    def _birth_or_merge(self, z, y):
        """One proposal of either kind; states stay numbered without gaps."""
        k = int(z.max()) + 1
        size = lambda n: math.lgamma(n) + math.log(self.gamma)  # noqa: E731  a state's weight in the prior of partitions
        if self.rng.random() < 0.5:  # birth: the ticks of a state above its mean leave
            j = int(self.rng.integers(k))
            here = z == j
            out = here & (y > y[here].mean())
            if out.any() and (here & ~out).any():
                gain = self._evidence(y[out]) + self._evidence(y[here & ~out]) - self._evidence(y[here])
                gain += size(out.sum()) + size((here & ~out).sum()) - size(here.sum())
                if math.log(self.rng.random()) < gain:
                    z = np.where(out, k, z)
        elif k > 1:  # merge: two states whose levels are neighbours
            means = np.argsort([y[z == j].mean() for j in range(k)])
            i = int(self.rng.integers(k - 1))
            a, b = z == means[i], z == means[i + 1]
            gain = self._evidence(y[a | b]) - self._evidence(y[a]) - self._evidence(y[b]) + size((a | b).sum()) - size(a.sum()) - size(b.sum())
            if math.log(self.rng.random()) < gain:
                z = np.unique(np.where(b, means[i], z), return_inverse=True)[1]
        return z

    def _shared(self, z, k):
        """Shared weights from the tables that each state's ticks take, and draws of the concentrations."""
        counts = counts_of(z, k)
        tables = np.array([max(1.0, sum((self.rng.random(int(n)) < self.alpha / k / (self.alpha / k + np.arange(int(n)))).sum() for n in counts[:, j])) for j in range(k)])
        m = tables.sum()
        eta = self.rng.beta(self.gamma + 1, m)
        self.gamma = float(np.clip(self.rng.gamma(1 + k - (self.rng.random() < m / (m + (k + 1) / max(1 - math.log(eta), 1e-9)))) / (1 - math.log(eta)), 0.1, 10.0))
        stays, moves = np.trace(counts), counts.sum() - np.trace(counts)
        rho = self.rng.beta(1 + stays, 1 + moves)
        self.kappa = float(np.clip(rho / max(1 - rho, 1e-6) * self.alpha, 1.0, 500.0))
        return self.rng.dirichlet(np.append(tables, self.gamma))

    def _level(self, y):
        n = len(y)
        mean = ((y + 1.27) / 2).sum() / (n + 0.5) + -4.5 * 0.5 / (n + 0.5)
        return mean + math.sqrt(4.93 / 4 / (n + 0.5)) * self.rng.standard_normal()


class HdpFilter:
    """Regimes of a whole series by the sampler, window by window, exported to a filter that runs through the window; a reducer."""

    OUTPUTS = "first_tick long, n_states int, ticks long, log_vol double, surprise double"

    def __init__(self, key=(), window=2000, least=20, sweeps=4, n=64):
        self.inner = Consecutive(key, self._make, window, least)
        self.sweeps, self.n = sweeps, n

    def _make(self, key, window):
        sampler = StickyHdp(key, window=window, sweeps=self.sweeps)
        finish, n = sampler.finish, self.n

        def run():
            if not finish():
                return []
            regimes, rows = sampler.export()
            if len(regimes) == 1:
                regimes, rows = regimes * 2, np.full((2, 2), 0.5)
            f = ParticleFilter(key, n=n, regimes=regimes, outlier=(0.02, 30.0))
            f.bank.a["t"][0] = rows
            out = [f.step(v) for v in sampler.y]
            return [(len(set(regimes)), len(out), float(np.mean([o[0] for o in out])), float(np.mean([o[7] for o in out])))]

        sampler.finish = run
        return sampler

    def push(self, y):
        return self.inner.push(y)

    def finish(self):
        return self.inner.finish()


class Rescued:
    """A learning filter with a sampler that can replace its cloud.

    A run is triggered by a small effective size, by a surprise far above its average, or
    after ``period`` ticks, but not within ``wait`` ticks of the last one. The sampler runs
    on the last ticks; its result goes through the gate. ``replace`` puts the sampler's
    cloud and levels in the place of the filter's; ``mix`` does so for half of the
    particles; else nothing changes.
    """

    OUTPUTS = "log_vol double, ess double, trigger string, decision string"

    def __init__(self, key=(), n=64, window=WINDOW, least=40, period=200, wait=30, small=0.1, surprise=4.0, particles=24):
        self.filter, self.ring, self.key = ParticleFilter(key, n=n, regimes=REGIMES[:3], learn=True, outlier=(0.02, 30.0)), deque(maxlen=window), key
        self.least, self.period, self.wait, self.small, self.surprise, self.particles = least, period, wait, small, surprise, particles
        self.since, self.average, self.t = 0, None, 0

    def _trigger(self, ess, surprise):
        if len(self.ring) < self.least or self.since < self.wait:
            return None
        if ess < self.small * self.filter.n:
            return "ess"
        if self.average is not None and surprise > self.average + self.surprise:
            return "surprise"
        return "periodic" if self.since >= self.period else None

    def step(self, y):
        self.ring.append(y)
        self.t, self.since = self.t + 1, self.since + 1
        out = self.filter.step(y)
        trigger, decision = self._trigger(out[5], out[7]), None
        self.average = out[7] if self.average is None else 0.05 * out[7] + 0.95 * self.average
        if trigger:
            self.since, decision = 0, self._rescue(out)
        return out[0], out[5], trigger, decision

    def _rescue(self, out):
        sampler = Pgas((*self.key, self.t), 1, len(self.ring), self.particles)
        for v in self.ring:
            sampler.push(v)
        rows = sampler.finish()
        if not rows:
            return "none"
        f, (regime, h, w) = self.filter, sampler.cloud
        live = {"mu": out[10], "sigma2": f.bank.sigma**2, "share": out[4], "t": f.t, "phi": 1 - float(f.bank.theta @ out[4]), "h": out[0], "ess": out[5] / f.n}
        rescue = {"mu": [r[1] for r in rows], "sigma2": [r[2] ** 2 for r in rows], "share": [r[4] for r in rows], "t": sampler.rows, "phi": float(sum(r[8] * r[4] for r in rows)), "h": float(w @ h), "ess": float(1 / (w @ w) / len(w))}
        decision, _ = gate(live, rescue)
        if decision in ("replace", "mix"):
            self.inject(decision, regime, h, w, rescue)
        return decision

    def inject(self, decision, regime, h, w, rescue) -> None:
        """Particles drawn from the sampler's cloud, all or every second one, with the sampler's levels as what is learnt."""
        f = self.filter
        take = np.arange(0, f.n, 1 if decision == "replace" else 2)
        u = float(generator(3, (*self.key, self.t)).random())
        drawn = np.minimum(np.searchsorted(np.cumsum(w), (u + np.arange(len(take))) / len(take)), len(w) - 1)
        f.regime[take], f.m[take], f.v[take] = regime[drawn], h[drawn], np.asarray(rescue["sigma2"])[regime[drawn]]
        f.logw[:] = 0.0
        f.mu[take] = f.nm[take] = np.asarray(rescue["mu"])
        f.s2[take] = np.asarray(rescue["sigma2"])


def alias_table(weights) -> tuple[np.ndarray, np.ndarray]:
    """Share and alias of each category, so that one uniform number draws one in constant time."""
    p = np.asarray(weights, float) * len(weights) / np.sum(weights)
    share, alias = np.ones(len(p)), np.arange(len(p))
    small, large = [i for i in range(len(p)) if p[i] < 1], [i for i in range(len(p)) if p[i] >= 1]
    while small and large:
        i, j = small.pop(), large[-1]
        share[i], alias[i] = p[i], j
        p[j] -= 1 - p[i]
        if p[j] < 1:
            small.append(large.pop())
    return share, alias


def alias_draw(share, alias, u):
    """Categories from uniform numbers."""
    at = np.minimum((np.asarray(u) * len(share)).astype(int), len(share) - 1)
    return np.where(np.asarray(u) * len(share) - at < share[at], at, alias[at])


class AliasTable:
    """A reducer: the table of a series' weights and the probabilities it stands for; it needs all weights of a series at once."""

    OUTPUTS = "i long, share double, alias long, p double"

    def __init__(self):
        self.weights = []

    def push(self, w):
        self.weights.append(w)

    def finish(self):
        share, alias = alias_table(self.weights)
        p = (share + np.bincount(alias, 1 - share, len(share))) / len(share)
        return [(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(share, alias, p))]


def align_by_level(mu: np.ndarray) -> np.ndarray:
    """Order that makes the levels ascend."""
    return np.argsort(mu, kind="stable")


def gate(live: dict, rescue: dict, limits: dict | None = None) -> tuple[str, dict]:
    """Whether a rescued cloud may replace the live one, from differences after aligning regimes by level.

    ``live`` and ``rescue``: mu, sigma2 and share by regime, transition rows t, phi
    and mean log-volatility h, ess share ess. Result: the decision (abort, discard,
    replace or mix) and the differences.
    """
    limits = {"mu": 1.0, "phi": 0.2, "sigma2": 0.5, "t": 0.3, "kl": 1.0, "h": 1.5, "ess": 0.1, "small": 0.2} | (limits or {})
    a, b = align_by_level(np.array(live["mu"])), align_by_level(np.array(rescue["mu"]))
    pick = lambda d, o, n: np.array(d[n], float)[o]
    t0, t1 = np.array(live["t"], float)[np.ix_(a, a)], np.array(rescue["t"], float)[np.ix_(b, b)]
    p, q = np.maximum(pick(live, a, "share"), 1e-10), np.maximum(pick(rescue, b, "share"), 1e-10)
    out = {
        "mu": float(np.abs(pick(live, a, "mu") - pick(rescue, b, "mu")).max()), "sigma2": float(np.abs(pick(live, a, "sigma2") - pick(rescue, b, "sigma2")).max()),
        "phi": abs(live["phi"] - rescue["phi"]), "t": float(np.linalg.norm(t0 - t1) / len(a)), "kl": float((q * np.log(q / p)).sum()), "h": abs(live["h"] - rescue["h"]),
    }
    values = [*out.values(), *np.ravel(t1), rescue["ess"]]
    if not all(map(math.isfinite, values)) or np.abs(t1.sum(1) - 1).max() > 1e-3:
        return "abort", out
    if rescue["ess"] < limits["ess"]:
        return "discard", out
    worst = max(out[n] / limits[n] for n in out)
    return ("discard" if worst > 3 else "replace" if worst > limits["small"] else "mix"), out


class Garch:
    """GARCH(1, 1) of one series' returns by likelihood over a grid that is refined; a reducer that reads the whole series once per grid."""

    OUTPUTS = "omega double, alpha double, beta double, loglik double, n long, mean double"

    def __init__(self, key=()):
        self.spool = Spool()

    def push(self, r):
        self.spool.append(r)

    @staticmethod
    def loglik(r2, var0, alpha, beta):
        """Log likelihoods of a grid; r2: squares in order, from any iterable."""
        omega = var0 * np.maximum(1 - alpha - beta, 1e-6)
        v, total = np.full_like(alpha, var0), np.zeros_like(alpha)
        for x in r2:
            total -= 0.5 * (math.log(2 * math.pi) + np.log(v) + x / v)
            v = omega + alpha * x + beta * v
        return total

    def finish(self):
        n = len(self.spool)
        if n < 20:
            return []
        mean = self.spool.mean()
        squares = lambda: (x for b in self.spool.blocks() for x in (b - mean) ** 2)
        var0 = float(sum(((b - mean) ** 2).sum() for b in self.spool.blocks()) / n)
        a, b, step = 0.1, 0.8, 0.1
        for _ in range(4):
            ga, gb = np.meshgrid(np.clip(a + step * np.arange(-4, 5) / 2, 0.001, 0.5), np.clip(b + step * np.arange(-8, 9) / 2, 0.0, 0.998))
            ga, gb = ga.ravel(), gb.ravel()
            ok = ga + gb < 0.999
            ga, gb = ga[ok], gb[ok]
            value = self.loglik(squares(), var0, ga, gb)
            best = int(value.argmax())
            a, b, step = float(ga[best]), float(gb[best]), step / 3
        return [(var0 * (1 - a - b), a, b, float(value[best]), n, float(mean))]
