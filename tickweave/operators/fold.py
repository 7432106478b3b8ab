"""Ordered folds: a state machine run over each series, one output row per tick.

Rows are dealt by key and sorted within partitions, and the kernel reads them as a
stream of Arrow batches. Memory doesn't depend on the length of a series, and
nothing is collected into arrays. A kernel is a class whose objects hold the state
of one series; ``step`` takes the inputs of a tick and returns the outputs. The
same classes run in Structured Streaming (``tickweave.streaming.runner``).

Kernels that are banks of NumPy arrays run over blocks of series, tick by tick
(``aligned_fold``): the first ticks of all series of a block, then the second ones, and
so on, so that a call moves many series. What is held is the state of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tickweave.runtime import ship_package

#: Output rows of a batch.
BATCH = 20_000
#: Series of a block that a bank holds, on average.
WIDTH = 32
#: Tasks of a blocked reduction; beyond, a task takes several blocks in turn.
TASKS = 4096


def schema_of(frame: DataFrame, kept: Sequence[str], outputs: str) -> StructType:
    fields = [frame.schema[c] for c in kept] + list(_parse_datatype_string(outputs).fields)
    return StructType(fields)


def dealt(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key in as many partitions as the session shuffles into.

    The number is given, as small partitions that are merged for their few bytes
    would leave cores idle: kernels cost far more than reading their rows.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ordered_fold(frame: DataFrame, key: str | Sequence[str], order: Sequence[str], inputs: Sequence[str], kernel: Callable[[], object], outputs: str, keep: Sequence[str] = (), keyed: bool = False) -> DataFrame:
    """Key, order, kept columns and the kernel's outputs (a DDL string), a row per input row.

    ``kernel`` makes a fresh state for each key (it gets the tuple of key values if
    ``keyed``, for random seeds or configurations); null keys are one series. Ties in
    ``order`` are in no defined order, so it should end with a unique column. An
    empty table gives no rows.
    """
    ship_package(frame.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    kept = list(dict.fromkeys([*keys, *order, *keep]))
    wanted = list(dict.fromkeys([*kept, *inputs]))
    schema = schema_of(frame, kept, outputs)
    n_out, names = len(schema) - len(kept), schema.names
    rows = dealt(frame.select(*wanted), keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(schema[i].dataType) for i in range(len(kept), len(names))]
        state, last = None, object()
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            values = list(zip(*(batch.column(c).to_pylist() for c in inputs)))
            for start in range(0, batch.num_rows, BATCH):
                out = []
                for now, value in zip(ids[start : start + BATCH], values[start : start + BATCH]):
                    if now != last:
                        state, last = kernel(now) if keyed else kernel(), now
                    out.append(state.step(*value))
                columns = list(zip(*out)) if out else [()] * n_out
                part = batch.slice(start, len(out))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(run, schema)


def ordered_reduce(frame: DataFrame, key: str | Sequence[str], order: Sequence[str], inputs: Sequence[str], kernel: Callable[[], object], outputs: str, keyed: bool = False) -> DataFrame:
    """Key and the rows that a kernel's ``finish`` returns after the last tick of a series.

    ``push`` takes a tick's inputs, and may return rows that are ready before the end.
    Kernels that need a window of ticks keep a bounded number of them, and those that
    need all ticks again and again a spool, so memory doesn't grow with the series.
    """
    ship_package(frame.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    schema = schema_of(frame, keys, outputs)
    rows = dealt(frame.select(*dict.fromkeys([*keys, *order, *inputs])), keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        state, last = None, object()

        def rows_of(found):
            out = [(*last, *row) for row in found or ()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema.names)

        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in keys))
            for now, value in zip(ids, zip(*(batch.column(c).to_pylist() for c in inputs))):
                if now != last:
                    if state is not None:
                        yield from rows_of(state.finish())
                    state, last = kernel(now) if keyed else kernel(), now
                if ready := state.push(*value):
                    yield from rows_of(ready)
        if state is not None:
            yield from rows_of(state.finish())

    return rows.mapInArrow(run, schema)


def blocked_reduce(frame: DataFrame, key: str | Sequence[str], order: Sequence[str], value: str, kernel: Callable[[], object], outputs: str, width: int = WIDTH) -> DataFrame:
    """Key and the rows that a kernel's ``run`` returns for the series of a block: their keys and their values in order.

    Blocks hold about ``width`` series, or fewer so that every core has one, dealt by a hash of
    the key; a block is a task, as kernels cost far more than reading their rows. Long series are
    spooled to a temporary file of the worker, so memory doesn't grow with their length. Null
    values are left out.
    """
    from tickweave.operators.spool import Spool

    ship_package(frame.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    schema, cores = schema_of(frame, keys, outputs), frame.sparkSession.sparkContext.defaultParallelism
    rows = frame.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order, value]), F.xxhash64(*keys).alias("__series"))
    blocks = max(cores, -(-rows.agg(F.approx_count_distinct("__series")).first()[0] // width))
    rows = rows.withColumn("__block", F.pmod(F.hash("__series"), F.lit(blocks)))
    rows = rows.repartitionById(min(blocks, TASKS), F.pmod("__block", F.lit(min(blocks, TASKS)))).sortWithinPartitions("__block", *keys, *order)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields]
        block, names, series = None, [], []

        def finished():
            out = [(*names[i], *row) for i, row in kernel().run(names, series)] if names else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema.names)

        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in keys))
            for where, now, x in zip(batch.column("__block").to_pylist(), ids, batch.column(value).to_pylist()):
                if where != block:
                    yield from finished()
                    block, names, series = where, [], []
                if not names or names[-1] != now:
                    names.append(now)
                    series.append(Spool())
                series[-1].append(x)
        yield from finished()

    return rows.mapInArrow(run, schema)


def _arrow(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An output of a bank: numbers, or a row of numbers for each series."""
    if x.ndim == 2:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()).cast(kind.value_type)).cast(kind)
    return pa.array(x).cast(kind)


def aligned_fold(frame: DataFrame, key: str | Sequence[str], order: Sequence[str], inputs: Sequence[str], bank: Callable[[], object], outputs: str, keep: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Like ``ordered_fold``, for a bank of many series: ``add`` takes keys of new series, ``step`` their places and arrays of inputs.

    Series are dealt into blocks of about ``width`` by a hash of the key, rows within a
    block are sorted by their number in the series, so the n-th ticks of all its series
    are stepped together. The results don't depend on the blocks, so the approximate
    count of series that sets their number changes nothing but speed. Null keys are one
    series, null inputs reach the bank as NaN. An empty table gives no rows.
    """
    ship_package(frame.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    kept = list(dict.fromkeys([*keys, *order, *keep]))
    schema = schema_of(frame, kept, outputs)
    names, parts = schema.names, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frame.select(*dict.fromkeys([*kept, *inputs]), F.xxhash64(*keys).alias("__series"))
    blocks = max(parts, -(-rows.agg(F.approx_count_distinct("__series")).first()[0] // width))
    rows = rows.withColumn("__block", F.pmod(F.hash("__series"), F.lit(blocks))).repartition(parts, "__block")
    rows = rows.withColumn("__tick", F.row_number().over(Window.partitionBy("__block", *keys).orderBy(*order)))
    rows = rows.sortWithinPartitions("__block", "__tick", "__series", *keys).drop("__series")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(schema[i].dataType) for i in range(len(kept), len(names))]
        block, state, places = None, None, {}
        for batch in batches:
            marks = np.stack([batch.column("__block").to_numpy(), batch.column("__tick").to_numpy()]) if batch.num_rows else np.empty((2, 0))
            starts = np.flatnonzero((np.diff(marks, axis=1, prepend=-1) != 0).any(0))
            ids = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            values = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs]
            found = [[] for _ in types]
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                if marks[0, a] != block:
                    block, state, places = marks[0, a], bank(), {}
                if new := [x for x in ids[a:b] if x not in places]:
                    places |= dict(zip(new, state.add(new).tolist()))
                at = np.array([places[x] for x in ids[a:b]])
                for out, x in zip(found, state.step(at, *(v[a:b] for v in values))):
                    out.append(x)
            if batch.num_rows:
                columns = [_arrow(np.concatenate(x), t) for x, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names)

    return rows.mapInArrow(run, schema)
