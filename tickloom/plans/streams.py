"""Streaming queries, run to the end of their input and checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.base import ET
from tickloom.plans.market import _CROSS
from tickloom.session import load
from tickloom.streaming import engine as E

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "events")  # session zone
    e = E.file_stream(spark, f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") + 1).alias("price"), (k + 1).alias("volume"))


# the last watermark closes every bar that ends ten seconds before the last tick
_CLOSED = f"WITH {ET}, lt AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM et), sb AS (SELECT symbol, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS bar_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM et GROUP BY 1, 2)"


@query(f"{_CLOSED} SELECT sb.* FROM sb, lt WHERE (bar_s + 3600) * 1000000 <= mark")
def s1_stream_bars(spark: SparkSession, d: str) -> DataFrame:
    return E.run_to_table(E.stream_bars(_ticks(spark, d), 3600).drop("ts"), E.shared_folder(spark), "bars")


@query(f"{_CLOSED} SELECT sb.* FROM sb")
def b3_s6_flushed_bars(spark: SparkSession, d: str) -> DataFrame:
    """Every bar, the last ones closed by an end-of-stream mark."""
    return E.flushed_bars(_ticks(spark, d), 3600, E.shared_folder(spark))


_HALF = "md AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS half FROM et)"


@query(f"WITH {ET}, {_HALF}, hi AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM et, md WHERE epoch_us(ts) >= half AND seq % 2 = 0), gr AS (SELECT count(*) AS late FROM (SELECT DISTINCT symbol, epoch_us(ts) // 3600000000 AS hour FROM et, md WHERE epoch_us(ts) < half) g, hi WHERE (hour + 1) * 3600000000 <= mark) SELECT (SELECT count(*) FROM et) AS rows, late FROM gr")
def s2_s5_i13_late_drops(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the ticks arrives first, one file a batch: what then comes of the earlier half is late, and counted.

    A batch is late against the watermark the batch before ran with, so the later half comes in two files.
    """
    from tickloom.plans.base import eticks

    folder = E.shared_folder(spark)
    t = eticks(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "seq", "price", "volume")
    half = t.agg(F.floor((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).alias("half")).scalar()
    first = F.unix_micros("ts") >= half
    even = F.col("seq") % 2 == 0
    for part in (first & even, first & ~even, ~first):  # in order of arrival
        t.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    bars = E.stream_bars(E.file_stream(spark, f"{folder}/feed", 1), 3600)
    return E.dropped_late(bars, folder, "late").agg(F.sum("rows").alias("rows"), F.sum("late").alias("late"))


@query(f"{_CLOSED}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_s DESC) AS back, row_number() OVER (PARTITION BY symbol ORDER BY bar_s) - 1 AS i FROM sb) SELECT symbol, bar_s, open, high, low, close, volume, i AS n FROM n WHERE back > 1")
def b2_emitted_bars(spark: SparkSession, d: str) -> DataFrame:
    return E.run_to_table(E.emitted_bars(_ticks(spark, d), 3600), E.shared_folder(spark), "emitted")


@query(f"WITH {_CROSS}, lt AS (SELECT max(epoch_us(ts)) - 10000000 AS mark FROM et) SELECT symbol, bar_s, guarded AS signal, close FROM flips, lt WHERE (bar_s + 3600) * 1000000 <= mark")
def s3_t19_stream_crossover(spark: SparkSession, d: str) -> DataFrame:
    """Bars go through a table between the two stateful steps, as through a broker's topic."""
    folder = E.shared_folder(spark)
    E.run_to_table(E.stream_bars(_ticks(spark, d), 3600).drop("ts"), folder, "bars")
    return E.run_to_table(E.stream_crossover(E.file_stream(spark, f"{folder}/bars/data"), 5, 20), folder, "signals")


@query(f"WITH {ET}, q AS (SELECT symbol, seq, epoch_us(ts) // 7200000000 AS stamp FROM et), n AS (SELECT *, lag(stamp) OVER (PARTITION BY symbol ORDER BY seq) AS ps FROM q) SELECT symbol, seq, stamp FROM n WHERE ps IS NULL OR ps <> stamp")
def s4_new_stamps(spark: SparkSession, d: str) -> DataFrame:
    q = _ticks(spark, d).select("symbol", "seq", F.floor(F.unix_micros("ts") / 7_200_000_000).alias("stamp"))
    return E.run_to_table(E.stream_new_stamps(q), E.shared_folder(spark), "stamps")


@query(f"WITH {ET}, r AS (SELECT symbol AS order_id, seq, seq // 7 AS f FROM et), g AS (SELECT *, f - coalesce(lag(f) OVER (PARTITION BY order_id ORDER BY seq), 0) AS fill FROM r) SELECT order_id, seq, fill FROM g WHERE fill > 0")
def s7_fill_increments(spark: SparkSession, d: str) -> DataFrame:
    r = _ticks(spark, d).select(F.col("symbol").alias("order_id"), "seq", F.floor(F.col("seq") / 7).alias("filled_qty"))
    return E.run_to_table(E.stream_fill_increments(r), E.shared_folder(spark), "fills")


@query(f"WITH {ET} SELECT symbol, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seqs FROM et GROUP BY symbol")
def i10_i12_topic_stream(spark: SparkSession, d: str) -> DataFrame:
    """Ticks published as topic messages and read back by a subscriber."""
    from tickloom.sources.files import subscribe, topic_lines

    t = _ticks(spark, d)
    m = topic_lines(t, "TICK_DATA", ["symbol", "seq", "price", "volume"])
    got = E.run_to_table(subscribe(m, "TICK_DATA", "symbol string, seq bigint, price double, volume bigint"), E.shared_folder(spark), "topic")
    return got.groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("seq").alias("seqs"))
