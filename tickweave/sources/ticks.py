"""Tick, bar and label views of the event and order tables, and readers of tick files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators.features import log_returns
from tickweave.runtime import table

#: Scale of the returns made from event values, which vary far more than prices do.
RETURN_SCALE = 0.01
#: Returns of this size or more are data errors.
BAD_RETURN = 0.5

TICK_FILE = "timestamp timestamp, close double, `return` double, event string"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, seq, px, event, ret; the first return of a series is null."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("px"), F.col("event_type").alias("event"),
    )
    return log_returns(events, "series_id", ["ts", "seq"], "px", "ret").withColumn("ret", F.col("ret") * F.lit(RETURN_SCALE))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that have a return."""
    return ticks(spark, sf_dir).where("ret is not null")


#: The same views for the SQL that queries are compared with.
TICKS_SQL = """ticks AS (
  SELECT user_id AS series_id, ts, event_id AS seq, value AS px, event_type AS event,
         CASE WHEN value > 0 AND last > 0 THEN ln(value / last) * 0.01::DOUBLE END AS ret
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS rn FROM ticks WHERE ret IS NOT NULL
)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close and volume of each series and day."""
    t = ticks(spark, sf_dir)
    first = F.struct("ts", "seq")
    return t.groupBy("series_id", F.to_date("ts").alias("day")).agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", first).alias("close"), F.sum("px").alias("volume"),
    )


BARS_SQL = """bars AS (
  SELECT series_id, ts::DATE AS day, arg_min(px, (ts, seq)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, seq)) AS close, sum(px) AS volume
  FROM ticks GROUP BY ALL
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series per order priority: the day's total price and its log return."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("px"))
    return log_returns(days, "series_id", ["ts"], "px", "ret").withColumn("ret", F.col("ret") * F.lit(RETURN_SCALE))


DAILY_SQL = """days AS (
  SELECT o_orderpriority AS series_id, o_orderdate AS ts, sum(o_totalprice) AS px FROM orders GROUP BY ALL
), daily AS (
  SELECT *, ln(px / lag(px) OVER (PARTITION BY series_id ORDER BY ts)) * 0.01::DOUBLE AS ret FROM days
)"""


def read_tick_files(spark: SparkSession, path: str, bad: float = BAD_RETURN) -> DataFrame:
    """Header CSV files ``timestamp,close,return[,event]``; empty lines and returns of ``bad`` or more are dropped."""
    rows = spark.read.schema(TICK_FILE).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "DROPMALFORMED").csv(path)
    return rows.where(F.abs("return") < bad)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV files ``date,return``; lines without both are dropped."""
    rows = spark.read.schema("date date, `return` double").option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.where("date is not null and `return` is not null")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic CSV files that carry a header, of any columns; their types come from the values, empty lines are skipped."""
    return spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def align(series: dict[str, DataFrame], on: str = "ts", price: str = "close") -> DataFrame:
    """Prices of several series as columns, only where all have one."""
    out = None
    for name, frame in series.items():
        one = frame.select(on, F.col(price).alias(name)).where(F.col(name).isNotNull())
        out = one if out is None else out.join(one, on)
    return out
