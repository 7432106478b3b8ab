"""Filter configurations by asset class, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: asset class, centre of log-volatility, distance of regimes, innovation deviation, stay probability, share of outliers, Student-t degrees.
PRESETS = (
    ("equity_index", -4.9, 0.6, 0.10, 0.97, 0.01, 8.0),
    ("single_stock", -4.2, 0.6, 0.14, 0.95, 0.02, 5.0),
    ("fx_major", -5.5, 0.5, 0.08, 0.97, 0.01, 8.0),
    ("fx_emerging", -5.0, 0.7, 0.14, 0.95, 0.03, 4.0),
    ("commodity", -4.3, 0.6, 0.12, 0.96, 0.02, 5.0),
    ("crypto", -3.6, 0.8, 0.20, 0.93, 0.04, 3.5),
    ("bond", -5.8, 0.5, 0.07, 0.98, 0.01, 8.0),
)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "asset string, centre double, spacing double, sigma double, stay double, outlier double, nu double")


def options(asset: str, regimes: int = 4) -> dict:
    """Options of a ParticleFilter for an asset class."""
    _, centre, spacing, sigma, stay, outlier, nu = next(p for p in PRESETS if p[0] == asset)
    rows = tuple((0.05 + 0.03 * i, centre + spacing * (i - (regimes - 1) / 2), sigma * (1 + 0.4 * i)) for i in range(regimes))
    return {"regimes": rows, "stay": stay, "outlier": (outlier, 30.0), "nu": nu}
