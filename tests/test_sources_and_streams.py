from functools import partial

from pyspark.sql import functions as F

from tickweave.operators import kernels as k
from tickweave.operators.fold import ordered_fold
from tickweave.operators.ranges import label_ranges
from tickweave.runtime import Scratch
from tickweave.sources import synthetic, ticks
from tickweave.streaming import runner

SCHEMA = "series_id long, ts timestamp, seq long, px double"


def test_tick_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,close,return,event\n2020-02-03, 100.5 ,0.01,\n\n2020-02-04,101,0.7,shock\n2020-02-05,99,-0.02,shock\n")
    rows = ticks.read_tick_files(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r["close"], r["return"], r["event"]) for r in rows] == [(100.5, 0.01, None), (99.0, -0.02, "shock")]


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    rows = [(s, f"2024-01-01 00:{m:02d}:00", m * 10 + s, 100.0 + m * (s + 1)) for m in range(30) for s in range(3)]
    frame = spark.createDataFrame(rows, "series_id long, ts string, seq long, px double").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    for part in range(3):
        frame.where(F.minute("ts").between(part * 10, part * 10 + 9)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = runner.run_to_end(runner.stream_fold(stream, "series_id", ["ts", "seq"], ["px"], partial(k.Ewma, 5), k.Ewma.OUTPUTS), Scratch(spark, "t"), "t")
    batch = ordered_fold(frame, "series_id", ["ts", "seq"], ["px"], partial(k.Ewma, 5), k.Ewma.OUTPUTS)
    assert out.where("late").count() == 0
    assert sorted(map(tuple, out.drop("late").collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_change_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    make = lambda rows: spark.createDataFrame(rows, "series_id long, ts string, seq long, px double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    make([(1, "2024-01-01 00:10:00", 10, 5.0)]).write.mode("append").parquet(source)
    make([(1, "2024-01-01 00:05:00", 5, 9.0), (1, "2024-01-01 00:15:00", 15, 5.0)]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    rows = runner.run_to_end(runner.stream_fold(stream, "series_id", ["ts", "seq"], ["px"], k.Ewma, k.Ewma.OUTPUTS), Scratch(spark, "t"), "t").collect()
    assert len(rows) == 3 and {r["vol"] for r in rows if not r["late"]} == {5.0} and [r["vol"] for r in rows if r["late"]] in ([None], [])


def test_streamed_bars(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, f"2024-01-0{d} 0{h}:00:00", d * 10 + h, float(d * 10 + h)) for d in (1, 2, 3, 4, 5) for h in range(3)]
    spark.createDataFrame(rows, "series_id long, ts string, seq long, px double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(source)
    out = runner.run_to_end(runner.windowed_bars(spark.readStream.schema(SCHEMA).parquet(source)), Scratch(spark, "t"), "bars")
    first = out.orderBy("start").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["n"]) == (10.0, 12.0, 10.0, 12.0, 3)


def test_fold_handles_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), (7, 1, 3.0)], "key long, at long, x double")
    out = ordered_fold(rows, "key", ["at"], ["x"], k.Ewma, k.Ewma.OUTPUTS)
    assert out.count() == 3 and out.where("key is null and at = 1").first()["vol"] == 1.0
    assert ordered_fold(rows.limit(0), "key", ["at"], ["x"], k.Ewma, k.Ewma.OUTPUTS).collect() == []


def test_overlapping_ranges_take_the_highest_priority(spark):
    ranges = spark.createDataFrame([("a", 0, 10, 1), ("b", 5, 7, 2), ("c", 7, 20, 3), ("d", 30, 30, 1)], "label string, start int, end int, priority int")
    rows = spark.range(35).select(F.col("id").cast("int").alias("t"))
    got = {r["t"]: r["label"] for r in label_ranges(rows, ranges, "t").collect()}
    want = {t: max(((p, n) for n, a, b, p in [("a", 0, 10, 1), ("b", 5, 7, 2), ("c", 7, 20, 3), ("d", 30, 30, 1)] if a <= t <= b), default=(0, None))[1] for t in range(35)}
    assert got == want


def test_synthetic_series(spark):
    a = synthetic.scenario_tape(spark, copies=2).orderBy("series_id", "tick").collect()
    assert len(a) == 15_000 and sum(r["is_outlier"] for r in a) == 20
    b = synthetic.scenario_tape(spark, copies=2).repartition(3).orderBy("series_id", "tick").collect()
    assert a == b
    days = synthetic.stochastic_volatility(spark, 300, 0.01, 0.95)
    assert 0.005 < days.agg(F.stddev("ret")).first()[0] < 0.05


def test_return_and_result_files(spark, tmp_path):
    from tickweave.sources import ticks

    (tmp_path / "r.csv").write_text("date,return\n2020-03-02,0.01\n\n2020-03-03,\n,0.3\n2020-03-04,-0.02\n")
    assert [(str(r["date"]), r["return"]) for r in ticks.read_returns(spark, str(tmp_path / "r.csv")).orderBy("date").collect()] == [("2020-03-02", 0.01), ("2020-03-04", -0.02)]
    (tmp_path / "d.csv").write_text("t,vol,event\n1,0.5,x\n\n2,0.25,\n")
    rows = ticks.read_results(spark, str(tmp_path / "d.csv")).orderBy("t").collect()
    assert [(r["t"], r["vol"], r["event"]) for r in rows] == [(1, 0.5, "x"), (2, 0.25, None)]
