"""Structured Streaming: tick sources, bars, stateful signals, order loops and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder or glob as a stream; a rate limit instead of a bounded queue with drops."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    parent, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles()):  # one file: a stream reads its folder
        reader, path = reader.option("pathGlobFilter", name), parent
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_bars(ticks: DataFrame, seconds: int, lateness: str = "10 seconds") -> DataFrame:
    """Tumbling bars in event time; ticks later than the watermark are dropped and counted by the engine.

    Late ticks within the watermark join their bar, so that no interval is emitted twice.
    """
    at = F.struct("ts", "seq")
    w = F.window("ts", f"{seconds} seconds")
    bars = ticks.withWatermark("ts", lateness).groupBy(w, "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.unix_seconds("window.start").alias("bar_s"), "open", "high", "low", "close", "volume", F.col("window.start").alias("ts"))


END = "__end__"  # the symbol of an end-of-stream mark


def flushed_bars(ticks: DataFrame, seconds: int, folder: str, lateness: str = "10 seconds") -> DataFrame:
    """All bars of a stream that ends: run to the end of its input, then to an end-of-stream mark that closes what is open.

    The mark is a tick in the far future beside the feed; the run resumes from its own checkpoint, so that every bar is
    emitted once.
    """
    spark, marks = ticks.sparkSession, f"{folder}/marks"
    feed = ticks.select("symbol", "ts", "seq", "price", "volume")
    far = spark.range(1).select(F.lit(END).alias("symbol"), F.lit("9999-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(0).alias("seq"), F.lit(0.0).alias("price"), F.lit(0).alias("volume"))
    far = far.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in feed.schema])
    far.limit(0).write.mode("overwrite").parquet(marks)
    bars = stream_bars(feed.unionByName(spark.readStream.schema(feed.schema).parquet(marks)), seconds, lateness).drop("ts")
    run_to_table(bars, folder, "bars")
    far.write.mode("append").parquet(marks)
    return run_to_table(bars, folder, "bars").where(F.col("symbol") != END)


def emitted_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    """Bars as an arrival-order builder emits them: a tick of any other interval closes the open one.

    A late tick thus emits the partial bar and reopens an older interval, and an interval may come more than
    once, numbered by ``n``. State per symbol: the open bar.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar = list(state.get) if state.exists else None
        columns = ["symbol", "bar_s", "open", "high", "low", "close", "volume", "n"]
        for pdf in batches:
            pdf = pdf.sort_values("seq", kind="stable")
            if not len(pdf):
                continue
            start, price, volume = (pdf["second"].to_numpy() // seconds * seconds).astype(np.int64), pdf["price"].to_numpy(float), pdf["volume"].to_numpy(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(start)) + 1])  # runs of one interval are bars
            last = np.append(first[1:], len(start)) - 1
            bars = pd.DataFrame({"symbol": key[0], "bar_s": start[first], "open": price[first], "high": np.maximum.reduceat(price, first), "low": np.minimum.reduceat(price, first), "close": price[last], "volume": np.add.reduceat(volume, first)})
            if bar is not None and bar[0] == start[0]:  # the first run continues the open bar
                bars.loc[0, ["open", "high", "low"]] = [bar[1], max(bar[2], bars["high"][0]), min(bar[3], bars["low"][0])]
                bars.loc[0, "volume"] += bar[5]
            elif bar is not None:
                bars = pd.concat([pd.DataFrame([(key[0], *bar[:6])], columns=columns[:7]), bars], ignore_index=True)
            bars["n"] = (bar[6] if bar is not None else 0) + np.arange(len(bars))
            bar = bars.iloc[-1][columns[1:]].tolist()
            bar = [int(bar[0]), *map(float, bar[1:5]), int(bar[5]), int(bar[6])]
            yield bars.iloc[:-1][columns]
        if bar is not None:
            state.update(tuple(bar))

    fields = "bar_s bigint, open double, high double, low double, close double, volume bigint, n bigint"
    return ticks.select("symbol", "seq", F.unix_seconds("ts").alias("second"), "price", "volume").groupBy("symbol").applyInPandasWithState(step, f"symbol string, {fields}", fields, "append", GroupStateTimeout.NoTimeout)


def stream_crossover(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Guarded crossover signals of closed bars; state per symbol: the last closes and whether it is long."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, held = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        for pdf in batches:
            pdf = pdf.sort_values("bar_s")
            c = np.concatenate([np.array(closes, float), pdf["close"].to_numpy(float)])
            at = np.arange(len(closes), len(c))[np.arange(len(closes), len(c)) >= long]  # bars with a long average on the bar before
            out = []
            if len(at):
                mean = lambda n: np.lib.stride_tricks.sliding_window_view(c, n).sum(axis=1) / n
                s, l = mean(short), mean(long)
                ps, pl, s, l = s[at - short], l[at - long], s[at - short + 1], l[at - long + 1]
                up, down = (ps <= pl) & (s > l), (ps >= pl) & (s < l)
                for k in np.flatnonzero(up | down):  # crossings only
                    if up[k] != held:
                        held = bool(up[k])
                        out.append((key[0], int(pdf["bar_s"].iloc[at[k] - len(closes)]), 1 if held else -1, float(c[at[k]])))
            closes = c[-(long + 1) :].tolist()
            yield pd.DataFrame(out, columns=["symbol", "bar_s", "signal", "close"])
        state.update((closes, held))

    return bars.select("symbol", "bar_s", "close").groupBy("symbol").applyInPandasWithState(step, "symbol string, bar_s bigint, signal int, close double", "closes array<double>, held boolean", "append", GroupStateTimeout.NoTimeout)


def stream_new_stamps(quotes: DataFrame) -> DataFrame:
    """Polled quotes whose stamp differs from the one before; state per symbol: the last stamp."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            keep = []
            pdf = pdf.sort_values("seq")
            for stamp in pdf["stamp"]:
                keep.append(last is None or stamp != last)
                last = int(stamp)
            yield pdf[keep][["symbol", "seq", "stamp"]]
        if last is not None:
            state.update((last,))

    return quotes.select("symbol", "seq", "stamp").groupBy("symbol").applyInPandasWithState(step, "symbol string, seq bigint, stamp bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def stream_fill_increments(reports: DataFrame) -> DataFrame:
    """New fills from cumulative order reports; state per order: what was filled so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values("seq")
            most = np.maximum.accumulate(np.append(done, pdf["filled_qty"].fillna(0).to_numpy(np.int64)))
            fill = np.diff(most)
            done = int(most[-1])
            yield pd.DataFrame({"order_id": key[0], "seq": pdf["seq"].to_numpy()[fill > 0], "fill": fill[fill > 0]})
        state.update((done,))

    return reports.select("order_id", "seq", "filled_qty").groupBy("order_id").applyInPandasWithState(step, "order_id string, seq bigint, fill bigint", "done bigint", "append", GroupStateTimeout.NoTimeout)


def match_orders(orders: DataFrame, fills: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream join of orders with their fills; state is bounded by the watermarks."""
    o = orders.withWatermark("ts", within).alias("o")
    f = fills.withWatermark("fill_ts", within).alias("f")
    return o.join(f, F.expr(f"o.order_id = f.fill_order_id AND fill_ts >= ts AND fill_ts <= ts + INTERVAL {within}"))


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of every query: batch, input rows and rows dropped as late."""

    def __init__(self) -> None:
        self.seen: dict[str, dict[str, Any]] = {}

    def onQueryStarted(self, event: Any) -> None:
        self.seen[str(event.id)] = {"state": "started"}

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.seen[str(p.id)] = {"state": "running", "batch": p.batchId, "rows": p.numInputRows, "late": late}

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.seen[str(event.id)] = {"state": "failed" if event.exception else "ended"}


def dropped_late(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run to the end of what is there and count, per micro-batch: rows read, and groups dropped as later than the watermark.

    A bounded queue drops what it cannot hold; here the source is limited instead, and only lateness drops. Late rows are
    counted after they are combined per window and key within their batch.
    """
    q = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{folder}/{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [(int(p["batchId"]), int(p["numInputRows"]), sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])) for p in q.recentProgress]
    return stream.sparkSession.createDataFrame(seen, "batch bigint, rows bigint, late bigint")


def run_to_table(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run to the end of what is there (available-now) into Parquet files, and read them back."""
    out = f"{folder}/{name}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def run_each_batch(stream: DataFrame, folder: str, name: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every micro-batch to a sink, as an execution loop does."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/{name}/state").trigger(availableNow=True).start().awaitTermination()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint directory."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
