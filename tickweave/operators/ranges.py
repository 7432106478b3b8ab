"""Range joins of ticks with labels and phases, as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import Scratch

#: Rows up to which the table of one size of pieces is broadcast.
BROADCAST_RANGES = 100_000


def dyadic(first: int, last: int):
    """(level, index) of the fewest aligned pieces, of 2^level numbers each, that make up [first, last]."""
    while first <= last:
        level = min((first & -first).bit_length() - 1 if first else 62, (last - first + 1).bit_length() - 1)
        yield level, first >> level
        first += 1 << level


def label_ranges(frame: DataFrame, ranges: DataFrame, at: str, start: str = "start", end: str = "end", label: str = "label", priority: str = "priority", out: str = "label", last: int | None = None) -> DataFrame:
    """Add the label of the range [start, end] that a row lies in; of several, that of the highest priority (of equal ones, the largest label).

    ``at``, ``start`` and ``end`` are whole numbers (days, ticks, microseconds). A range is
    cut into aligned pieces, at most two of each power of two, so a number lies in one
    possible piece of each size. Rows are joined by equality with the pieces of each size
    that occurs, and keep the best label; they are never multiplied, and a table of
    pieces is broadcast only if it is small. Null positions, and those in no range, have a
    null label; ranges with a null end, or that end before they start, are left out.
    ``last``, a number that no position exceeds, clips ranges without a real end, which
    would else have pieces of every size.
    """
    fields = {f.name: f.dataType.simpleString() for f in ranges.schema.fields}

    def cut(frames):
        import pandas as pd

        for f in frames:
            rows = [(level, index, p, x) for a, z, p, x in zip(f["a"], f["z"], f["p"], f["x"]) for level, index in dyadic(int(a), int(z))]
            yield pd.DataFrame(rows, columns=["level", "index", "p", "x"])

    known = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(start).cast("long").alias("a"), F.least(F.col(end).cast("long"), F.lit(last)).alias("z"), F.col(priority).alias("p"), F.col(label).alias("x"))
    pieces = known.mapInPandas(cut, f"level int, index long, p {fields[priority]}, x {fields[label]}")
    pieces = Scratch(frame.sparkSession, "ranges").write(pieces.groupBy("level", "index").agg(F.max(F.struct("p", "x")).alias("best")), "pieces")
    counts = {r["level"]: r["count"] for r in pieces.groupBy("level").count().collect()}  # 63 sizes at most
    rows, found = frame, []
    for level, count in sorted(counts.items()):
        one = pieces.where(F.col("level") == level).select(F.col("index").alias(f"__i{level}"), F.col("best").alias(f"__b{level}"))
        rows = rows.join(F.broadcast(one) if count <= BROADCAST_RANGES else one, F.shiftright(F.col(at).cast("long"), level) == F.col(f"__i{level}"), "left")
        found.append(f"__b{level}")
    best = F.greatest(*found) if len(found) > 1 else F.col(found[0]) if found else None
    value = F.lit(None).cast(fields[label]) if best is None else best["x"]
    return rows.withColumn(out, value).drop(*found, *(f"__i{level}" for level in counts))
