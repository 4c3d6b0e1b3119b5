"""Streams against batch: bars, late ticks, stateful signals, order loops."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import bars, signals
from tickloom.streaming import engine

T0 = dt.datetime(2024, 1, 1)


def write(spark, folder, parts):
    """One file per part, so that each part is a micro-batch of its own."""
    for rows in parts:
        df = spark.createDataFrame([("A", T0 + dt.timedelta(seconds=s), i, float(p), v) for s, i, p, v in rows], "symbol string, ts timestamp, seq long, price double, volume long")
        df.coalesce(1).write.mode("append").parquet(folder)


def test_bars_equal_batch_and_late_ticks_are_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [[(1, 1, 10, 1), (30, 2, 12, 1), (70, 3, 11, 1)], [(50, 4, 9, 1), (200, 5, 13, 1)], [(205, 6, 13, 1)], [(5, 7, 99, 1), (400, 8, 14, 1)]])
    watch = engine.Heartbeat()
    spark.streams.addListener(watch)
    try:
        got = engine.run_to_table(engine.stream_bars(engine.file_stream(spark, src, 1), 60, "30 seconds").drop("ts"), str(tmp_path), "bars").orderBy("bar_s").collect()
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        spark.streams.removeListener(watch)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    assert [(r["bar_s"] - base, r["open"], r["high"], r["low"], r["close"]) for r in got] == [(0, 10.0, 12.0, 9.0, 9.0), (60, 11.0, 11.0, 11.0, 11.0), (180, 13.0, 13.0, 13.0, 13.0)]
    # the tick at 5 s came after the watermark had passed its bar; the bar at 360 s is still open
    assert any(s["state"] == "ended" for s in watch.seen.values())


def test_arrival_order_bars_reopen_an_interval(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [[(1, 1, 10, 1), (70, 2, 11, 2)], [(50, 3, 9, 4), (130, 4, 12, 8)]])
    got = engine.run_to_table(engine.emitted_bars(engine.file_stream(spark, src, 1), 60), str(tmp_path), "emitted").orderBy("n").collect()
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    assert [(r["bar_s"] - base, r["close"], r["volume"], r["n"]) for r in got] == [(0, 10.0, 1, 0), (60, 11.0, 2, 1), (0, 9.0, 4, 2)]


def test_stateful_crossover_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(0)
    px = [100.0]
    for _ in range(300):
        px.append(round(px[-1] + rng.gauss(0, 1), 3))
    rows = [("A", i * 60, p) for i, p in enumerate(px)]
    src = str(tmp_path / "in")
    for lo in range(0, len(rows), 80):
        spark.createDataFrame(rows[lo : lo + 80], "symbol string, bar_s long, close double").coalesce(1).write.mode("append").parquet(src)
    got = {tuple(r) for r in engine.run_to_table(engine.stream_crossover(engine.file_stream(spark, src), 5, 20), str(tmp_path), "x").select("bar_s", "signal").collect()}
    batch = signals.long_flat(signals.crossover(spark.createDataFrame(rows, "symbol string, bar_s long, close double"), 5, 20, guarded=True))
    assert got == {tuple(r) for r in batch.select("bar_s", "signal").collect()}


def test_orders_meet_their_fills(spark, tmp_path):
    o, f = str(tmp_path / "o"), str(tmp_path / "f")
    t = lambda m: T0 + dt.timedelta(minutes=m)
    spark.createDataFrame([("x", t(0)), ("y", t(5))], "order_id string, ts timestamp").write.parquet(o)
    spark.createDataFrame([("x", t(10), 5), ("x", t(90), 1), ("z", t(1), 2)], "fill_order_id string, fill_ts timestamp, qty long").write.parquet(f)
    j = engine.match_orders(engine.file_stream(spark, o), engine.file_stream(spark, f)).select("order_id", "qty")
    assert [tuple(r) for r in engine.run_to_table(j, str(tmp_path), "j").collect()] == [("x", 5)]


def test_batch_sink_sees_every_row_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, [[(i, i, 1, 1) for i in range(5)], [(i, i, 1, 1) for i in range(5, 9)]])
    engine.run_each_batch(engine.file_stream(spark, src, 1), str(tmp_path), "sink", lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == list(range(9))


def test_batch_bars_of_the_same_input(spark):
    rows = [("A", T0 + dt.timedelta(seconds=s), i, float(i), 1) for i, s in enumerate((0, 10, 60))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, volume long")
    assert bars.time_bars(df, 60).agg(F.sum("volume")).head()[0] == 3


def test_publisher_sends_batches_in_order_of_time(spark):
    from tickloom.sources.files import replay

    df = spark.range(10).selectExpr("timestamp_seconds(100 - id) AS ts", "id AS seq", "id * 2 AS price").repartition(3)
    got = list(replay(df, 4))
    assert [len(b) for b in got] == [4, 4, 2] and [x for b in got for x in b["seq"]] == list(range(9, -1, -1))
    assert list(replay(df.limit(0), 4)) == []
