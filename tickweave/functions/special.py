"""Special functions and densities as column expressions, evaluated on the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickweave.functions.fixed import LOG_CHI_MEAN, LOG_CHI_VARIANCE, MIXTURE_MEANS, MIXTURE_VARIANCES, MIXTURE_WEIGHTS

_LOG_2PI = math.log(2 * math.pi)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive x: recurrence to x + 8, then Stirling's series."""
    shift, z = F.log(total([F.lit(0.0)]) + x), x + 8
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    i = 1 / z
    series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i / 1188))))
    return (z - 0.5) * F.log(z) - z + 0.5 * _LOG_2PI + series - shift


def digamma(x: Column) -> Column:
    """Derivative of lgamma for positive x: recurrence to x + 6, then the asymptotic series."""
    shift, z = 1 / x, x + 6
    for k in range(1, 6):
        shift = shift + 1 / (x + k)
    i2 = 1 / (z * z)
    return F.log(z) - 0.5 / z - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132)))) - shift


def log_sum_exp(parts: Sequence[Column]) -> Column:
    top = F.greatest(*parts)
    return top + F.log(total([F.exp(p - top) for p in parts]))


def gaussian_logpdf(x: Column, mean, variance) -> Column:
    d = x - _lit(mean)
    return -0.5 * (_LOG_2PI + F.log(_lit(variance)) + d * d / _lit(variance))


def student_t_logpdf(x: Column, mean, scale, nu) -> Column:
    nu, z = _lit(nu), (x - _lit(mean)) / _lit(scale)
    return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * F.log(nu * math.pi) - F.log(_lit(scale)) - (nu + 1) / 2 * F.log1p(z * z / nu)


def mixture_logpdf(y: Column, log_vol) -> Column:
    """Density of y = log r^2 for a log-volatility, by the ten-component mixture."""
    parts = []
    for w, m, v in zip(MIXTURE_WEIGHTS, MIXTURE_MEANS, MIXTURE_VARIANCES):
        d = y - 2 * _lit(log_vol) - m
        parts.append(F.lit(math.log(w) - 0.5 * (_LOG_2PI + math.log(v))) - d * d / (2 * v))
    return log_sum_exp(parts)


def moment_logpdf(y: Column, log_vol) -> Column:
    """Single-normal approximation of the same density, without its constant."""
    d = y - 2 * _lit(log_vol) + LOG_CHI_MEAN
    return -0.5 * d * d / LOG_CHI_VARIANCE


def sigmoid_discount(z: Column, centre: float = 2.0, steep: float = 2.0, most: float = 0.12) -> Column:
    """Logistic discount, nothing below z = -5 and all of it above z = 10."""
    return F.when(z < -5, F.lit(0.0)).when(z > 10, F.lit(most)).otherwise(most / (1 + F.exp(-steep * (z - centre))))


def huber_gradient(error: Column, delta: float = 1.0) -> Column:
    return F.greatest(F.least(error, F.lit(delta)), F.lit(-delta))


def kelly_multiplier(age: Column, expected: Column, hazard: Column) -> Column:
    """Smaller bets late in a regime and where it is likely to end."""
    return F.greatest(F.least(1.5 - 0.5 * age / expected, F.lit(1.0)), F.lit(0.3)) * (1 - hazard)


def logit_on(x: Column, low: float, high: float) -> Column:
    p = (x - low) / (high - low)
    return F.log(p / (1 - p))


def inverse_logit_on(x: Column, low: float, high: float) -> Column:
    return low + (high - low) / (1 + F.exp(-x))


def log_beta_density(x: Column, a: float, b: float) -> Column:
    """Density of Beta(a, b) without its constant."""
    return (a - 1) * F.log(x) + (b - 1) * F.log(1 - x)


def log_multivariate_beta(alphas: Sequence[Column]) -> Column:
    return total([lgamma(a) for a in alphas]) - lgamma(total(alphas))


def dirichlet_entropy(alphas: Sequence[Column]) -> Column:
    a0 = total(alphas)
    return log_multivariate_beta(alphas) + (a0 - len(alphas)) * digamma(a0) - total([(a - 1) * digamma(a) for a in alphas])


def dirichlet_kl(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """KL divergence of Dirichlet(p) from Dirichlet(q)."""
    p0 = total(p)
    return log_multivariate_beta(q) - log_multivariate_beta(p) + total([(a - b) * (digamma(a) - digamma(p0)) for a, b in zip(p, q)])


def _fisher_argument(m1, s1, m2, s2) -> Column:
    return 1 + ((m1 - m2) * (m1 - m2) / 2 + (s1 - s2) * (s1 - s2)) / (2 * s1 * s2)


def fisher_rao_distance(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """Geodesic distance between normals N(m, s^2) in the Fisher information metric."""
    return math.sqrt(2) * F.acosh(_fisher_argument(m1, s1, m2, s2))


def fisher_rao_point(m1: Column, s1: Column, m2: Column, s2: Column, t: float) -> tuple[Column, Column]:
    """Mean and deviation at share ``t`` of the geodesic, a circle of the half plane (m / sqrt 2, s)."""
    x1, x2 = m1 / math.sqrt(2), m2 / math.sqrt(2)
    straight = F.abs(x1 - x2) < 1e-9
    centre = ((x2 * x2 + s2 * s2) - (x1 * x1 + s1 * s1)) / (2 * (x2 - x1))
    radius = F.sqrt((x1 - centre) * (x1 - centre) + s1 * s1)
    a1, a2 = F.log(F.tan(F.atan2(s1, x1 - centre) / 2)), F.log(F.tan(F.atan2(s2, x2 - centre) / 2))
    angle = 2 * F.atan(F.exp(a1 + t * (a2 - a1)))
    level = F.exp(F.log(s1) + t * (F.log(s2) - F.log(s1)))
    return F.when(straight, m1).otherwise(math.sqrt(2) * (centre + radius * F.cos(angle))), F.when(straight, level).otherwise(radius * F.sin(angle))


def hawkes_kernel(age: Column, kind: str, beta: float, power: float = 1.5) -> Column:
    """Decay of an event's influence: exponential, power_law or sum_exp (fast and slow halves)."""
    if kind == "exponential":
        return F.exp(-beta * age)
    if kind == "power_law":
        return F.pow(1 + beta * age, F.lit(-power))
    if kind == "sum_exp":
        return 0.5 * F.exp(-2 * beta * age) + 0.5 * F.exp(-0.5 * beta * age)
    raise ValueError(f"unknown kernel {kind!r}")


def hawkes_mark(size: Column, kind: str, gamma: float = 1.0) -> Column:
    """Influence of an event by its size: none, linear, quadratic or exponential."""
    marks = {"none": F.lit(1.0), "linear": gamma * size, "quadratic": gamma * size * size, "exponential": F.exp(gamma * size) - 1}
    if kind not in marks:
        raise ValueError(f"unknown mark {kind!r}")
    return marks[kind]
