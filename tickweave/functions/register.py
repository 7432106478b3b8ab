"""The scalar functions for use from SQL text: temporary SQL functions, without Python in the plan."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from tickweave.functions.fixed import MIXTURE_MEANS, MIXTURE_VARIANCES, MIXTURE_WEIGHTS

_PARTS = " + ".join(f"{w}D / sqrt({2 * math.pi * v!r}D) * exp(0D - pow(y - 2D * log_vol - ({m}D), 2D) / {2 * v!r}D)" for w, m, v in zip(MIXTURE_WEIGHTS, MIXTURE_MEANS, MIXTURE_VARIANCES))

FUNCTIONS = {
    "log_square(r DOUBLE)": "CASE WHEN abs(r) < 1e-10D THEN -23D ELSE ln(r * r) END",
    "zero_clamp(r DOUBLE, low DOUBLE)": "CASE WHEN abs(r) < low THEN CASE WHEN r < 0 THEN -low ELSE low END ELSE r END",
    "mixture_logpdf(y DOUBLE, log_vol DOUBLE)": f"ln({_PARTS})",
    "gaussian_logpdf(x DOUBLE, mean DOUBLE, variance DOUBLE)": f"-0.5D * ({math.log(2 * math.pi)!r}D + ln(variance) + (x - mean) * (x - mean) / variance)",
    "sigmoid_discount(z DOUBLE)": "CASE WHEN z < -5 THEN 0D WHEN z > 10 THEN 0.12D ELSE 0.12D / (1D + exp(-2D * (z - 2D))) END",
    "fisher_rao_distance(m1 DOUBLE, s1 DOUBLE, m2 DOUBLE, s2 DOUBLE)": "sqrt(2D) * acosh(1D + ((m1 - m2) * (m1 - m2) / 2D + (s1 - s2) * (s1 - s2)) / (2D * s1 * s2))",
    "kelly_multiplier(age DOUBLE, expected DOUBLE, hazard DOUBLE)": "greatest(least(1.5D - 0.5D * age / expected, 1D), 0.3D) * (1D - hazard)",
}


def register(spark: SparkSession, prefix: str = "tw_") -> list[str]:
    """Create the functions in the session; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS DOUBLE RETURN {body}")
    return [prefix + s.split("(")[0] for s in FUNCTIONS]
