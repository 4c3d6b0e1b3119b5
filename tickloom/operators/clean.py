"""Cleaning, back-adjustment, panels and universe filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.running import day_of, running
from tickloom.functions.scalars import finite


def forward_fill(ticks: DataFrame, by: str = "symbol", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Prices carried forward per key; rows before the first price are dropped, missing volumes are 0.

    One extra column, ``was_filled``. Non-finite prices count as missing.
    """
    p = finite("price")
    out = running(ticks.withColumn("was_filled", p.isNull()), [by], list(order), day_of(order[0]), lasts={"price": p})
    return out.where("price IS NOT NULL").withColumn("volume", F.coalesce("volume", F.lit(0)))


def fill_report(ticks: DataFrame, by: str = "symbol") -> DataFrame:
    """Per key: rows, rows without a price, without a volume, and leading rows that filling drops."""
    p = finite("price")
    filled = running(ticks, [by], ["ts", "seq"], day_of("ts"), lasts={"seen": p})
    return filled.withColumn("leading", F.col("seen").isNull()).groupBy(by).agg(
        F.count("*").alias("rows"), F.count_if(p.isNull()).alias("no_price"), F.count_if(F.col("volume").isNull()).alias("no_volume"), F.count_if("leading").alias("dropped"))


def valid_actions(actions: DataFrame) -> DataFrame:
    """Actions, checked: any kind but split and dividend fails the job."""
    known = F.col("action").isin("split", "dividend")
    return actions.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("NULL"))))))


def back_adjust(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """Prices (symbol, date, close, volume) adjusted for later splits and dividends.

    Rows strictly before an action's date change: a split by r divides prices and multiplies volumes by r,
    a dividend d scales prices by 1 - d / c with c the raw close before that date. Ratios that are not
    positive, and dividends not below c, are skipped. Factors multiply up from the latest date backwards.
    """
    w = Window.partitionBy("symbol").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # actions and prices in one ordered stream: the close before an action is the last one seen
    px = prices.select("symbol", "date", F.lit(1).alias("kind"), "close", "volume", F.lit(None).cast("string").alias("action"), F.lit(None).cast("double").alias("value"))
    ac = actions.select("symbol", "date", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume"), "action", "value")
    both = px.withColumn("volume", F.col("volume").cast("double")).unionByName(ac).withColumn("raw", F.last("close", ignorenulls=True).over(w))
    split = (F.col("action") == "split") & (F.col("value") > 0)
    dividend = (F.col("action") == "dividend") & (F.col("value") > 0) & (F.col("value") < F.col("raw"))
    both = both.withColumn("pf", F.when(split, 1 / F.col("value")).when(dividend, 1 - F.col("value") / F.col("raw")).otherwise(F.lit(1.0))).withColumn("vf", F.when(split, F.col("value")).otherwise(F.lit(1.0)))
    # later actions only: an action on a row's own date comes before that row and leaves it alone
    later = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("lp", F.sum(F.log("pf")).over(later)).withColumn("lv", F.sum(F.log("vf")).over(later)).where("kind = 1")
    return out.select("symbol", "date", (F.col("close") * F.exp("lp")).alias("close"), (F.col("volume") * F.exp("lv")).alias("volume"), F.exp("lp").alias("factor"))


def close_panel(prices: DataFrame) -> DataFrame:
    """Dense (date, symbol, close, volume, was_filled) from the day all symbols trade: gaps carry the last close, volume too.

    The distinct dates are numbered, so that a gap is a range of numbers: each row is repeated up to the row before its
    symbol's next one, and neither the grid nor the universe's names are ever built. A column tells what was filled.
    """
    live = prices.groupBy("symbol").agg(F.min("date").alias("first")).agg(F.max("first").alias("live"))
    dates = prices.where("date IS NOT NULL").select("date").distinct()
    all_ = Window.partitionBy(F.lit(0))  # date-level rows
    dates = dates.withColumn("at_", F.row_number().over(all_.orderBy("date"))).withColumn("end_", F.count("*").over(all_))
    w = Window.partitionBy("symbol").orderBy("at_")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    own = prices.select("date", "symbol", "close", "volume").join(dates, "date").withColumn("was_filled", F.col("close").isNull())
    own = own.withColumn("close", F.last("close", ignorenulls=True).over(so_far)).withColumn("volume", F.coalesce(F.last("volume", ignorenulls=True).over(so_far), F.lit(0)))
    until = F.greatest(F.coalesce(F.lead("at_").over(w) - 1, F.col("end_")), F.col("at_"))
    out = own.withColumn("until_", until).withColumn("of_", F.explode(F.sequence("at_", "until_"))).withColumn("was_filled", F.col("was_filled") | (F.col("of_") > F.col("at_")))
    day = dates.select(F.col("at_").alias("of_"), F.col("date").alias("day_"))
    return out.join(day, "of_").where(F.col("day_") >= live.scalar()).select(F.col("day_").alias("date"), "symbol", "close", "volume", "was_filled")


def simple_returns(panel: DataFrame, by: str = "symbol", order: str = "date") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return panel.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).where("ret IS NOT NULL")


def extreme_returns(returns: DataFrame, limit: float = 0.45) -> DataFrame:
    return returns.where(F.abs("ret") > limit)


def universe(df: DataFrame, min_price: float = 5.0, max_price: float = 10_000.0, min_volume: float = 1e6, min_days: int = 0, date: str = "date") -> DataFrame:
    """Rows within the price and volume limits whose symbol is listed for at least ``min_days``."""
    listed = F.datediff(F.col(date), F.min(date).over(Window.partitionBy("symbol")))
    out = df.withColumn("listed_days", listed) if min_days else df
    keep = F.col("close").between(min_price, max_price) & (F.col("volume") >= min_volume)
    return out.where(keep & (F.col("listed_days") >= min_days)).drop("listed_days") if min_days else out.where(keep)


def zero_nonfinite(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull() & finite(c).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def nonfinite_count(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNotNull() & finite(c).isNull()).alias(f"bad_{c}") for c in columns], F.bool_and(F.greatest(*[finite(c).isNull() for c in columns]) == F.lit(False)).alias("all_finite"))


def filter_stats(df: DataFrame, kept: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("kept", kept.agg(F.count("*")).scalar()).withColumn("dropped", F.col("total") - F.col("kept"))


def complete_cases(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(F.greatest(*[finite(c).isNull() for c in columns]) == F.lit(False))


def route(bars: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Bars to every strategy subscribed to their symbol; double subscriptions deliver once."""
    return bars.join(subscriptions.select("strategy", "symbol").distinct(), "symbol")


def missing_share(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.col(column).isNull().cast("int")).alias("missing"))
