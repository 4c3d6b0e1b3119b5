"""Tumbling time bars and calendar aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bars(ticks: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV per key and epoch-aligned interval [start, start + seconds); empty intervals give no bar.

    Equal instants are ordered by seq. NULL prices are left out. Partial aggregates are made before the shuffle,
    so a hot symbol costs one row per task and interval.
    """
    at = F.struct("ts", "seq")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds
    return ticks.where("price IS NOT NULL").groupBy(*keys, start.cast("bigint").alias("bar_s")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))


def to_daily(equity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last equity of each calendar day; days without rows give none."""
    return equity.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.max_by("equity", F.struct("ts", "seq")).alias("equity"))


def trades_by_day(trades: DataFrame, symbols: list[str]) -> DataFrame:
    """Quantities per date, a column per symbol (the list is given, so no extra pass finds it)."""
    return trades.groupBy("date").pivot("symbol", symbols).agg(F.sum("quantity"))


def trades_by_hour(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("trades"))


def sessions(trades: DataFrame, gap_s: int = 3600, by: str = "symbol") -> DataFrame:
    """Trades with the seconds since the one before and a session number; a longer gap starts a session."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    since = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6
    out = trades.withColumn("since_s", since)
    return out.withColumn("session", F.sum(F.when(F.col("since_s") > gap_s, 1).otherwise(0)).over(w))


def median_gap_count(rows: DataFrame, by: str, second: str, upper: bool = True) -> DataFrame:
    """Missing grid rows per key: the usual step is the median of the positive steps.

    ``upper``: the upper median, and a gap where a step exceeds one and a half of it (integer
    arithmetic); otherwise the interpolated median, and half-even rounding of the multiple. Fewer
    than three rows or two steps give 0. The steps of a key are gathered as counts by size, which is bounded
    by the number of distinct steps.
    """
    w = Window.partitionBy(by).orderBy(second)
    steps = rows.select(by, (F.col(second) - F.lag(second).over(w)).alias("d"))
    sizes = steps.where("d > 0").groupBy(by, "d").agg(F.count("*").alias("n"))
    up = Window.partitionBy(by).orderBy("d")
    sizes = sizes.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    holds = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)  # noqa: E731  rank r from 0
    at = lambda r: F.max(F.when(holds(r), F.col("d"))).over(Window.partitionBy(by))
    if upper:
        sizes = sizes.withColumn("e", at(F.floor(F.col("all") / 2)))
        more = F.when(F.col("d") > F.col("e") + F.floor(F.col("e") / 2), F.floor((F.col("d") + F.floor(F.col("e") / 2)) / F.col("e")) - 1)
    else:
        sizes = sizes.withColumn("e", (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2)
        k = F.rint(F.col("d") / F.col("e"))
        more = F.when(k > 1, k - 1)
    gaps = sizes.groupBy(by).agg(F.when(F.max("all") >= 2, F.coalesce(F.sum(more * F.col("n")), F.lit(0))).otherwise(0).cast("bigint").alias("gaps"))
    counts = rows.groupBy(by).agg(F.count("*").alias("rows"))
    return counts.join(gaps, by, "left").select(by, "rows", F.when(F.col("rows") >= 3, F.coalesce("gaps", F.lit(0))).otherwise(0).alias("gaps"))


def bar_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
