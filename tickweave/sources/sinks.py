"""Sinks: tick files, flattened arrays, summary matrices, configurations and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def flatten(frame: DataFrame, width: int | None = None) -> DataFrame:
    """Array columns as ``name_0``, ``name_1``, ...; what is missing is null. For formats without arrays.

    There are as many columns as the longest array has values, which is counted first, or
    ``width``; a longer array then raises when the rows are written.
    """
    arrays = [f.name for f in frame.schema.fields if isinstance(f.dataType, ArrayType)]
    if not arrays:
        return frame
    if width is None:
        longest = frame.agg(*[F.max(F.size(F.col(f"`{a}`"))).alias(f"n{i}") for i, a in enumerate(arrays)]).first()
        widths = {a: max(0, longest[f"n{i}"] or 0) for i, a in enumerate(arrays)}
    else:
        widths = dict.fromkeys(arrays, width)
    columns = []
    for field in frame.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in widths:
            fits = F.when(F.size(c) > widths[field.name], F.raise_error(F.lit(f"{field.name} has more than {widths[field.name]} values")).cast(field.dataType)).otherwise(c)
            columns += [F.get(fits, F.lit(i)).alias(f"{field.name}_{i}") for i in range(widths[field.name])]
        else:
            columns.append(c)
    return frame.select(*columns)


def write(frame: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Per-tick results as parquet, orc, json or csv (arrays flattened, with a header)."""
    out = (flatten(frame) if kind == "csv" else frame).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.option("header", True).format(kind).save(path)


def matrix(frame: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Long results as one row per ``row`` and a column per name in ``columns``."""
    return frame.groupBy(row).pivot(column, columns).agg(F.first(value))


def key_values(config: dict) -> list[tuple[str, float]]:
    """A configuration as (parameter, value) rows."""
    return sorted((k, float(v)) for k, v in config.items())


def snippet(config: dict, name: str = "TunedFilter") -> str:
    """Python source that builds the best configuration."""
    inside = ", ".join(f"{k}={v!r}" for k, v in sorted(config.items()))
    return f"{name} = dict({inside})\n"


def tuner_table(frame: DataFrame, path: str, kind: str = "csv") -> None:
    """Tuning results as one wide file: knobs, metrics and score, best first (at most a grid's rows)."""
    frame.orderBy("score").coalesce(1).write.mode("errorifexists").option("header", True).format(kind).save(path)
