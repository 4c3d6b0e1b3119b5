"""Performance measures of equity curves, trades and pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import normal_cdf, rows
from tickloom.functions.spread import spread


def curve_returns(equity: DataFrame, by: str, order: str = "date") -> DataFrame:
    return equity.withColumn("ret", F.try_divide(F.col("equity"), F.lag("equity").over(Window.partitionBy(by).orderBy(order))) - 1).where("ret IS NOT NULL")


def sharpe(returns: DataFrame, by: str, periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """Annual Sharpe ratio over a yearly risk-free rate; 0 below two returns or without spread."""
    x = F.col("ret") - risk_free / periods
    return returns.groupBy(by).agg(F.coalesce(F.try_divide(F.avg(x), F.stddev_samp(x)) * periods**0.5, F.lit(0.0)).alias("sharpe"))


def growth(equity: DataFrame, by: str, order: str = "date", periods: int = 252) -> DataFrame:
    """Largest drawdown, compound annual growth over n - 1 periods, and their ratio (0 without drawdown)."""
    e = equity.withColumn("dd", F.try_divide(F.col("equity"), F.max("equity").over(rows(by, order))) - 1)
    g = e.groupBy(by).agg(F.count("*").alias("n"), F.min("dd").alias("max_drawdown"), F.min_by("equity", order).alias("first"), F.max_by("equity", order).alias("last"))
    cagr = F.when((F.col("n") > 1) & (F.col("first") > 0), F.pow(F.col("last") / F.col("first"), F.lit(float(periods)) / (F.col("n") - 1)) - 1).otherwise(0.0)
    return g.withColumn("cagr", cagr).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0)).select(by, "n", "max_drawdown", "cagr", "calmar")


def turnover(trades: DataFrame, equity: DataFrame, by: str, periods: int = 252) -> DataFrame:
    """Traded value over mean equity, per year of equity rows."""
    t = trades.groupBy(by).agg(F.sum(F.abs("quantity") * F.col("price")).alias("traded"))
    e = equity.groupBy(by).agg(F.avg("equity").alias("mean_equity"), (F.count("*") / periods).alias("years"))
    return e.join(t, by, "left").select(by, (F.try_divide(F.coalesce("traded", F.lit(0.0)), F.col("mean_equity")) / F.col("years")).alias("turnover"))


def alpha_beta(returns: DataFrame, benchmark: DataFrame, by: str, order: str = "date", periods: int = 252) -> DataFrame:
    """Regression on a benchmark over the dates both have; NULL below three."""
    m = returns.join(benchmark.select(order, F.col("ret").alias("bench")), order)
    return m.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.regr_slope("ret", "bench")).alias("beta"), F.when(F.count("*") >= 3, F.regr_intercept("ret", "bench") * periods).alias("alpha"))


def summary(equity: DataFrame, by: str, order: str = "date", periods: int = 252) -> DataFrame:
    return growth(equity, by, order, periods).join(sharpe(curve_returns(equity, by, order), by, periods), by, "left")


def crude_measures(equity: DataFrame, by: str, order: str, periods: int) -> DataFrame:
    """Total return, volatility of returns, their ratio, and a Sharpe ratio at the rows' own frequency."""
    r = curve_returns(equity, by, order).groupBy(by).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    t = equity.groupBy(by).agg((F.try_divide(F.max_by("equity", order), F.min_by("equity", order)) - 1).alias("total_return"))
    return t.join(r, by).select(by, "total_return", F.col("sd").alias("volatility"), F.try_divide(F.col("total_return"), F.col("sd")).alias("ratio"), (F.try_divide(F.col("m"), F.col("sd")) * periods**0.5).alias("sharpe"))


def trade_stats(trades: DataFrame, by: str) -> DataFrame:
    value = F.abs("quantity") * F.col("price")
    buy, sell = F.col("type") == "BUY", F.col("type") == "SELL"
    return trades.groupBy(by).agg(F.count("*").alias("trades"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.sum(F.abs("quantity")).alias("shares"), F.sum(value).alias("value"), F.sum(F.when(sell, value).when(buy, -value).otherwise(0.0)).alias("net_cash"))


def side_vwap(trades: DataFrame, by: str) -> DataFrame:
    return trades.groupBy(by, "type").agg(F.try_divide(F.sum(F.abs("quantity") * F.col("price")), F.sum(F.abs("quantity"))).alias("vwap"))


def pair_search(returns: DataFrame, order: str = "date", least: int = 30) -> DataFrame:
    """All pairs of the universe with correlation, hedge ratio and R2 of closes on common dates.

    The pairs are the answer (n (n - 1) / 2 of a universe of names); rows meet on the date only.
    """
    a = returns.select(order, F.col("symbol").alias("a"), F.col("close").alias("xa"))
    b = returns.select(order, F.col("symbol").alias("b"), F.col("close").alias("xb"))
    m = a.join(b, order).where("a < b")
    return m.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("xa", "xb").alias("corr"), F.regr_slope("xa", "xb").alias("hedge"), F.regr_r2("xa", "xb").alias("r2")).where(F.col("n") >= least)


def unit_root_t(resid: np.ndarray, lags: int = 0) -> float:
    """Dickey-Fuller t statistic of a residual series with so many lagged differences (no constant)."""
    return _lagged_fit(resid, lags, lags)[0]


def _lagged_fit(x: np.ndarray, lags: int, trimmed: int) -> tuple[float, float]:
    """(t of the level, information criterion of the fit), over the differences after the first ``trimmed``."""
    d = np.diff(x)
    y = d[trimmed:]
    design = np.column_stack([x[trimmed:-1], *[d[trimmed - k : len(d) - k] for k in range(1, lags + 1)]])
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    e = y - design @ coef
    n, k = design.shape
    ss = float(e @ e)
    error = np.sqrt(ss / max(n - k, 1) * np.linalg.pinv(design.T @ design)[0, 0])
    t = float(coef[0] / error) if error > 0 else float("-inf")
    return t, n * np.log(max(ss / n, 1e-300)) + 2 * k


def lag_count(x: np.ndarray) -> int:
    """Lagged differences by the least information criterion, up to 12 (n / 100)^(1/4)."""
    n = len(x)
    most = max(min(n // 2 - 1, int(np.ceil(12 * (n / 100) ** 0.25))), 0)
    return int(np.argmin([_lagged_fit(x, k, most)[1] for k in range(most + 1)]))


# MacKinnon's (1994) approximation of the p-value of a co-integration test of two series with a constant:
# bounds of the statistic, where the two polynomials part, and their coefficients from the constant on.
P_LOWEST, P_HIGHEST, P_PARTING = -18.86, 0.92, -2.62
P_SMALL = (2.92, 1.5012, 0.039796)
P_LARGE = (2.1945, 0.64695, -0.29198, -0.042377)


def cointegration_p(t: Column) -> Column:
    """P-value of an Engle-Granger statistic."""
    poly = lambda cs: sum((F.lit(c) * F.pow(t, F.lit(i)) for i, c in enumerate(cs)), F.lit(0.0))
    inside = normal_cdf(F.when(t <= P_PARTING, poly(P_SMALL)).otherwise(poly(P_LARGE)))
    return F.when(t > P_HIGHEST, F.lit(1.0)).when(t < P_LOWEST, F.lit(0.0)).otherwise(inside)


def cointegration(panel: DataFrame, pairs: DataFrame, order: str = "date", lags: int | None = None) -> DataFrame:
    """The given pairs with hedge intercept, Engle-Granger statistic and p-value.

    ``lags`` states the lagged differences of the unit root test; None chooses them per pair by information criterion. The
    more negative the statistic, the stronger; a perfect fit has -inf and p 0.
    """
    a = pairs.join(panel.select(F.col("symbol").alias("a"), order, F.col("close").alias("xa")), "a")
    m = a.join(panel.select(F.col("symbol").alias("b"), order, F.col("close").alias("xb")), ["b", order])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y, x = pdf["xa"].to_numpy(float), pdf["xb"].to_numpy(float)
        design = np.column_stack([np.ones(len(x)), x])
        coef, *_ = np.linalg.lstsq(design, y, rcond=None)
        resid = y - design @ coef
        spread_ = ((y - y.mean()) ** 2).sum()
        perfect = spread_ == 0 or (resid @ resid) / spread_ < 100 * np.finfo(float).eps
        t = float("-inf") if perfect else unit_root_t(resid, lag_count(resid) if lags is None else lags)
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "alpha": [coef[0]], "t": [t]})

    fits = spread(m.select("a", "b", order, "xa", "xb"), "a", "b").groupBy("a", "b").applyInPandas(run, "a string, b string, alpha double, t double")
    return pairs.join(fits, ["a", "b"]).withColumn("p", cointegration_p(F.col("t")))


def cointegrated(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """The pairs whose p-value lies below the level."""
    return tested.where(F.col("p") < level)


def rank_pairs(pairs: DataFrame, p: str = "p") -> DataFrame:
    return pairs.withColumn("score", 0.4 * (1 - F.col(p)) + 0.4 * F.col("r2") + 0.2 * F.abs("corr")).orderBy(F.desc("score"), "a", "b")


def strategy_counts(trades: DataFrame, by: str = "strategy") -> DataFrame:
    """Trades per strategy and each one's share of all."""
    c = trades.groupBy(by).agg(F.count("*").alias("trades"))
    return c.withColumn("share", F.col("trades") / F.sum("trades").over(Window.partitionBy(F.lit(0))))  # a row a strategy


def runtime_estimate(rows: DataFrame, per_second: float) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), (F.count("*") / per_second).alias("seconds"))
