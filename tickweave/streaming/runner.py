"""The batch kernels in Structured Streaming, with their state kept by key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructType

from tickweave.operators.fold import schema_of
from tickweave.runtime import Scratch, ship_package, table

STATE = "kernel binary, last binary"


def stream_fold(frame: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], kernel: Callable, outputs: str, keyed: bool = False) -> DataFrame:
    """Key, order columns, the kernel's outputs and ``late``, for a streaming frame.

    Rows of a micro-batch are sorted by ``order``. A row that isn't later than the
    last of its key was seen too late: it changes no state and comes out with null
    outputs and ``late`` true, so that it can be routed elsewhere.
    """
    ship_package(frame.sparkSession)
    schema = schema_of(frame, [key, *order], outputs)
    names = schema.names[1 + len(order) :]
    full = StructType([*schema.fields]).add("late", BooleanType())

    def run(group, frames, state):
        machine, last = (pickle.loads(x) for x in state.get) if state.exists else (kernel(group) if keyed else kernel(), None)
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        out, late = [], []
        for at, values in zip(rows[list(order)].itertuples(index=False, name=None), rows[list(inputs)].itertuples(index=False, name=None)):
            late.append(last is not None and at <= last)
            if late[-1]:
                out.append((None,) * len(names))
            else:
                out.append(machine.step(*values))
                last = at
        state.update((pickle.dumps(machine), pickle.dumps(last)))
        done = rows[[key, *order]].reset_index(drop=True)
        for i, name in enumerate(names):
            done[name] = pd.Series([o[i] for o in out], dtype=object)
        done["late"] = late
        yield done

    wanted = list(dict.fromkeys([key, *order, *inputs]))
    return frame.select(*wanted).groupBy(key).applyInPandasWithState(run, full, STATE, "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file or a folder
    return rows.select(F.col("user_id").alias("series_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("px"))


def run_to_end(stream: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Process all that the source has, exactly once, and read the sink."""
    sink, checkpoint = scratch.path(f"{name}-sink"), scratch.path(f"{name}-checkpoint")
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def replay(spark: SparkSession, sf_dir: str, inputs, kernel, outputs, keyed: bool = False) -> DataFrame:
    """The events through a kernel as a stream; rows that came in time."""
    stream = stream_fold(event_stream(spark, sf_dir), "series_id", ["ts", "seq"], inputs, kernel, outputs, keyed)
    return run_to_end(stream, Scratch(spark, "stream"), "replay").where("not late")


def windowed_bars(stream: DataFrame, length: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Bars of event time on a stream; what comes later than ``lateness`` is dropped by the watermark."""
    first = F.struct("ts", "seq")
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    bars = rows.groupBy("series_id", F.window("at", length).alias("w")).agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", first).alias("close"), F.sum("px").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return bars.select("series_id", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")
