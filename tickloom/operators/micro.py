"""Order-flow imbalance and volume-synchronised toxicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import normal_cdf
from tickloom.functions.running import day_of, overlapping, running


CHUNK = 65_536  # rows of one key that are walked in one task


def _signed(df: DataFrame) -> DataFrame:
    """Column e from a quote and the one before it, ``was_``."""
    was = lambda c: F.col("was_")[c]
    bid = F.when(F.col("bid") > was("bid"), F.col("bid_size")).when(F.col("bid") < was("bid"), -was("bid_size")).otherwise(F.col("bid_size") - was("bid_size"))
    ask = F.when(F.col("ask") > was("ask"), was("ask_size")).when(F.col("ask") < was("ask"), -F.col("ask_size")).otherwise(was("ask_size") - F.col("ask_size"))
    return df.withColumn("e", F.when(was("bid").isNotNull(), bid + ask)).drop("was_")


def flow_events(quotes: DataFrame, by: str = "symbol", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Signed change of resting size between snapshots, as ``e``, and the number of each snapshot of its key, ``n_``; the
    first one has no change (NULL). Walked by days with a carry between them, so that no key is one task."""
    return _signed(running(quotes, [by], list(order), day_of(order[0]), sums={"n_": F.lit(1)}, before={"was_": F.struct("bid", "ask", "bid_size", "ask_size")}))


def rolling_flow(events: DataFrame, n: int = 50, by: str = "symbol") -> DataFrame:
    """Sum of the last n events, NULL where all of them are, in chunks that overlap by n - 1 rows."""
    c = overlapping(events, "n_", max(CHUNK, 2 * n), back=n - 1)
    w = Window.partitionBy(by, "chunk_").orderBy("n_").rowsBetween(-(n - 1), 0)
    return c.withColumn("ofi", F.sum("e").over(w)).where("own_").drop("chunk_", "own_")


def volume_buckets(trades: DataFrame, size: int, by: str = "symbol") -> DataFrame:
    """Full buckets of equal volume: (by, bucket, price, ts, seq) with the price of the trade that fills each.

    A large trade fills several; the unfinished last bucket gives no row. Trades without price or volume are left out.
    """
    return _filled(running(trades.where("price IS NOT NULL AND volume > 0"), [by], ["ts", "seq"], day_of("ts"), sums={"cum": F.col("volume")}), size, by)


def _filled(cum: DataFrame, size: int, by: str) -> DataFrame:
    first, last = F.floor((F.col("cum") - F.col("volume")) / size) + 1, F.floor(F.col("cum") / size)
    full = cum.where(last >= first).withColumn("bucket", F.explode(F.sequence(first, last)))
    return full.select(by, "bucket", "price", "ts", "seq")


def imbalance(change: Column, sigma: Column) -> Column:
    """|2 Phi(change / sigma) - 1|: the absolute imbalance of buys; without spread 0."""
    return F.when(sigma > 0, F.abs(2 * normal_cdf(change / F.nullif(sigma, F.lit(0.0))) - 1)).otherwise(0.0)


def vpin(buckets: DataFrame, n: int, by: str = "symbol") -> DataFrame:
    """Mean imbalance of the last n buckets, NULL until there are n.

    Price changes between buckets are scaled by their sample deviation so far, the current one included. Buckets are
    numbered without gaps, so that changes come from overlapping chunks, and deviations from running counts, sums and sums
    of squares with a carry between chunks.
    """
    size = max(CHUNK, 2 * n)
    c = overlapping(buckets, "bucket", size, back=1)
    b = c.withColumn("dp", F.col("price") - F.lag("price").over(Window.partitionBy(by, "chunk_").orderBy("bucket"))).where("own_ AND dp IS NOT NULL").drop("chunk_", "own_")
    b = running(b, [by], ["bucket"], F.floor((F.col("bucket") - 1) / size), sums={"k_": F.lit(1), "s_": F.col("dp"), "ss_": F.col("dp") * F.col("dp")})
    var = (F.col("ss_") - F.col("s_") * F.col("s_") / F.col("k_")) / F.nullif(F.col("k_") - 1, F.lit(0))
    sigma = F.when(var * F.col("k_") > 1e-14 * F.col("ss_"), F.sqrt(var)).otherwise(0.0)  # equal changes have none, whatever the rounding
    b = b.withColumn("sigma", sigma).withColumn("imbalance", imbalance(F.col("dp"), F.col("sigma"))).drop("k_", "s_", "ss_")
    c = overlapping(b, "bucket", size, back=n - 1)
    last = Window.partitionBy(by, "chunk_").orderBy("bucket").rowsBetween(-(n - 1), 0)
    return c.withColumn("vpin", F.when(F.count("imbalance").over(last) == n, F.avg("imbalance").over(last))).where("own_").drop("chunk_", "own_")


def toxicity(ticks: DataFrame, bucket: int, n: int, flow: int = 50, by: str = "symbol") -> DataFrame:
    """Ticks with their number ``n_``, rolling flow and the latest VPIN known at each (the bucket a tick fills counts for it).

    One walk by days numbers ticks and adds up volume; how many buckets a tick has filled is then an equi-join with the
    buckets' VPIN.
    """
    usable = F.col("price").isNotNull() & (F.col("volume") > 0)
    t = running(ticks, [by], ["ts", "seq"], day_of("ts"), sums={"n_": F.lit(1), "cum": F.when(usable, F.col("volume"))}, before={"was_": F.struct("bid", "ask", "bid_size", "ask_size")})
    v = vpin(_filled(t.where(usable), bucket, by), n, by).select(F.col(by).alias("of_"), F.col("bucket").alias("filled_"), "vpin")
    met = rolling_flow(_signed(t).withColumn("at_", F.floor(F.col("cum") / bucket)), flow, by)
    return met.join(v, F.col(by).eqNullSafe(F.col("of_")) & (F.col("at_") == F.col("filled_")), "left").drop("cum", "at_", "of_", "filled_")
