"""Rolling indicators per series and cross-sectional transforms per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import filled, index_quantile, rows


def moving_average(x: str, by: str, order: str, n: int) -> Column:
    """Mean of the last n values; 0 until there are n."""
    w = rows(by, order, n)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w)).otherwise(0.0)


def moving_deviation(x: str, by: str, order: str, n: int) -> Column:
    """Population deviation of the last n values; 0 until there are n."""
    w = rows(by, order, n)
    return F.when(F.count(x).over(w) == n, F.stddev_pop(x).over(w)).otherwise(0.0)


def rolling_deviation(x: str, by: str, order: str, n: int) -> Column:
    """Population deviation over however many values there are, 0 for one."""
    return F.coalesce(F.stddev_pop(x).over(rows(by, order, n)), F.lit(0.0))


def rolling_covariance(x: str, y: str, by: str, order: str, n: int) -> Column:
    return F.covar_pop(x, y).over(rows(by, order, n))


def rolling_variance(x: str, by: str, order: str, n: int) -> Column:
    return F.var_pop(x).over(rows(by, order, n))


def winsorised(df: DataFrame, x: str, by: str, q: float = 0.01) -> DataFrame:
    """x clamped to the order statistics floor(n q) and floor(n (1 - q)) of its group, as ``<x>_w``.

    A group is one date's cross-section, whose size is the universe's; NULLs stay NULL.
    """
    limits = df.groupBy(by).agg(F.sort_array(F.collect_list(x)).alias("v")).select(by, index_quantile(F.col("v"), q).alias("lo_"), index_quantile(F.col("v"), 1 - q).alias("hi_"))
    return df.join(limits, by, "left").withColumn(f"{x}_w", F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("lo_")), F.col("hi_")))).drop("lo_", "hi_")


def winsorised_cases(df: DataFrame, columns: list[str], by: str, q: float = 0.01) -> DataFrame:
    """Rows that have all the columns, these clamped as by ``winsorised`` in their group: one aggregate for all of them."""
    whole = df.dropna(subset=columns)
    limits = whole.groupBy(by).agg(*[F.sort_array(F.collect_list(c)).alias(f"v_{c}") for c in columns])
    limits = limits.select(by, *[index_quantile(F.col(f"v_{c}"), x).alias(f"{n}_{c}") for c in columns for n, x in (("lo", q), ("hi", 1 - q))])
    met = whole.join(limits, by).withColumns({c: F.least(F.greatest(F.col(c), F.col(f"lo_{c}")), F.col(f"hi_{c}")) for c in columns})
    return met.select(df.columns)


def zscored(x: str, by: str | list[str]) -> Column:
    """Population z-score in the group; a group without spread gets 0."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop(x).over(w)
    return (F.col(x) - F.avg(x).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)


def rolling_standardised(returns: DataFrame, n: int) -> DataFrame:
    """(r - mean) / sample deviation over the n last returns, this one included; dates lacking any symbol are dropped."""
    w = rows("symbol", "date", n)
    sd = F.stddev_samp("ret").over(w)
    z = filled(F.col("ret"), w, n, F.when(sd > 0, (F.col("ret") - F.avg("ret").over(w)) / sd))
    each = returns.withColumn("z", z)
    return each.withColumn("whole", F.count("z").over(Window.partitionBy("date")) == F.count("*").over(Window.partitionBy("date"))).where("whole").drop("whole")


def spread_z(x: str, by: str, order: str, n: int, current: bool = False) -> Column:
    """z of a spread against the n spreads before it (population; NULL for no spread), or including it (sample)."""
    if current:
        w = rows(by, order, n)
        return filled(F.col(x), w, n, F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)))
    w = rows(by, order, n, gap=1)
    sd = F.stddev_pop(x).over(w)
    return filled(F.col(x), w, n, F.when(sd >= 1e-7, (F.col(x) - F.avg(x).over(w)) / sd))


def rolling_sharpe(x: str, by: str, order: str, n: int = 63, periods: int = 252) -> Column:
    w = rows(by, order, n)
    return filled(F.col(x), w, n, F.try_divide(F.avg(x).over(w), F.stddev_samp(x).over(w)) * periods**0.5)


def drawdown(x: str, by: str, order: str) -> Column:
    top = F.max(x).over(rows(by, order))
    return F.try_divide(F.col(x) - top, top)


def rolling_beta(y: str, x: str, by: str, order: str, n: int, least: int, shrink: float = 0.0) -> Column:
    """Covariance over variance of the last n rows, shrunk towards 1; NULL below ``least`` rows or without variance."""
    w = rows(by, order, n)
    var = F.var_pop(x).over(w)
    return F.when((F.count(x).over(w) >= least) & (var != 0), shrink + (1 - shrink) * F.covar_pop(y, x).over(w) / var)


def with_beta(df: DataFrame, y: str, x: str, by: str, order: str, n: int, least: int, shrink: float = 0.0) -> DataFrame:
    """Adds beta and resid_sigma; a row without beta enters the residual window as 0, as in the original model."""
    out = df.withColumn("beta", rolling_beta(y, x, by, order, n, least, shrink))
    resid = F.coalesce(F.col(y) - F.col("beta") * F.col(x), F.lit(0.0))
    return out.withColumn("resid_", resid).withColumn("resid_sigma", F.when(F.col("beta").isNotNull(), F.stddev_pop("resid_").over(rows(by, order, n)))).drop("resid_")


def regime_features(df: DataFrame, by: str = "symbol", order: str = "date", long: int = 21, short: int = 5, volume: int = 63, periods: int = 252) -> DataFrame:
    """Realised volatility (long and short), volatility of it, range and volume ratio; incomplete rows are dropped."""
    year = periods**0.5
    lw, sw, vw = rows(by, order, long), rows(by, order, short), rows(by, order, volume)
    out = df.withColumn("rv_long", filled(F.col("ret"), lw, long, F.stddev_samp("ret").over(lw) * year)).withColumn("rv_short", filled(F.col("ret"), sw, short, F.stddev_samp("ret").over(sw) * year))
    out = out.withColumn("vov", filled(F.col("rv_long"), lw, long, F.stddev_samp("rv_long").over(lw)))
    span = F.try_divide(F.max("close").over(sw) - F.min("close").over(sw), F.avg("close").over(sw))
    out = out.withColumn("range_short", filled(F.col("close"), sw, short, span)).withColumn("volume_ratio", filled(F.col("volume"), vw, volume, F.when(F.avg("volume").over(vw) > 0, F.log(F.nullif("volume", F.lit(0)) / F.avg("volume").over(vw)))))
    return out.dropna(subset=["rv_long", "rv_short", "vov", "range_short", "volume_ratio"])


def with_cumulative_log(returns: DataFrame, by: str = "symbol", order: str = "date") -> DataFrame:
    return returns.withColumn("cum", F.sum(F.log1p("ret")).over(rows(by, order)))


def reversal_signal(by: str, order: str, k: int) -> Column:
    """Minus the k-row log return; reads ``cum``."""
    return -(F.col("cum") - F.lag("cum", k).over(Window.partitionBy(by).orderBy(order)))


def skipped_momentum(by: str, order: str, long: int = 252, skip: int = 21) -> Column:
    """Log return from ``long`` to ``skip`` rows ago; reads ``cum``."""
    w = Window.partitionBy(by).orderBy(order)
    return F.lag("cum", skip).over(w) - F.lag("cum", long).over(w)


def rank_positions(df: DataFrame, signal: str, share: float = 0.2, by: str = "date", name: str = "symbol") -> DataFrame:
    """+1 for the top and -1 for the bottom k of a date, k = max(1, half-even(n share)) and at most n / 2."""
    has = F.col(signal).isNotNull().cast("int")
    up, down = Window.partitionBy(by, has).orderBy(signal, name), Window.partitionBy(by, has).orderBy(F.desc(signal), F.desc(name))
    n = F.sum(has).over(Window.partitionBy(by))
    k = F.least(F.greatest(F.lit(1), F.bround(n * share).cast("int")), F.floor(n / 2))
    return df.withColumn("pos", F.when((has == 0) | (n < 2), 0).when(F.row_number().over(down) <= k, 1).when(F.row_number().over(up) <= k, -1).otherwise(0))


def factor_trio(df: DataFrame, by: str = "symbol", order: str = "date", long: int = 60, short: int = 20) -> DataFrame:
    """Momentum (long less short return), annualised population volatility, and value (minus the long return)."""
    w = Window.partitionBy(by).orderBy(order)
    back = lambda n: F.try_divide(F.col("close"), F.lag("close", n - 1).over(w)) - 1
    vol = filled(F.col("ret"), rows(by, order, short), short, F.stddev_pop("ret").over(rows(by, order, short)) * 252**0.5)
    return df.select("*", (back(long) - back(short)).alias("momentum"), vol.alias("vol"), (-back(long)).alias("val"))


def composite(df: DataFrame, factors: list[str], by: str = "date") -> DataFrame:
    """Mean of the population z-scores of the factors on a date."""
    return df.withColumn("composite", sum((zscored(f, by) for f in factors), F.lit(0.0)) / len(factors))


def top_bottom(df: DataFrame, score: str, n: int, by: str = "date", name: str = "symbol") -> DataFrame:
    """Weight 1/n for the n best and -1/n for the n worst of a date; the best win where both apply."""
    up, down = Window.partitionBy(by).orderBy(F.asc_nulls_last(score), name), Window.partitionBy(by).orderBy(F.desc_nulls_last(score), name)
    live = F.col(score).isNotNull()
    return df.withColumn("weight", F.when(live & (F.row_number().over(down) <= n), 1.0 / n).when(live & (F.row_number().over(up) <= n), -1.0 / n).otherwise(0.0))


def balance_sides(df: DataFrame, by: str = "date") -> DataFrame:
    """Longs times, shorts divided by, the ratio of the smaller to the larger side."""
    w = Window.partitionBy(by)
    long, short = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).over(w), F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).over(w)
    ratio = F.when((long > 0) & (short > 0), F.least(long, short) / F.greatest(long, short)).otherwise(1.0)
    return df.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight") * ratio).otherwise(F.col("weight") / ratio))


def damped(current: Column, target: Column, keep: float = 0.9) -> Column:
    """Part of the way from the current to the target weight."""
    return current + keep * (target - current)


def rebalance_rows(df: DataFrame, every: int, by: str = "symbol", order: str = "date") -> DataFrame:
    """Rows on which a book is rebalanced: each (every + 1)-th date."""
    return df.withColumn("turn_", F.row_number().over(Window.partitionBy(by).orderBy(order)) % (every + 1)).where("turn_ = 0").drop("turn_")


def cumulative_quantity(df: DataFrame, n: int = 20, by: str = "symbol") -> DataFrame:
    return df.withColumn("cum_qty", F.sum("quantity").over(rows(by, ["ts", "seq"]))).withColumn("recent_qty", F.sum("quantity").over(rows(by, ["ts", "seq"], n)))
