"""Cross-sectional regression, information coefficients, blending and mean-variance weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import rows
from tickloom.functions.spread import spread
from tickloom.operators.windows import winsorised, winsorised_cases, zscored


def composite_alpha(df: DataFrame, weights: dict[str, float], by: str = "date", q: float = 0.01) -> DataFrame:
    """Weighted sum of winsorised z-scores on a date; the weights must add up to 1."""
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("factor weights must add up to 1")
    for f in weights:
        df = winsorised(df, f, by, q)
    return df.withColumn("alpha", sum((F.coalesce(zscored(f"{f}_w", by), F.lit(0.0)) * w for f, w in weights.items()), F.lit(0.0)))


def regress_two(df: DataFrame, y: str, x1: str, x2: str, by: str, q: float = 0.01, least: int = 1) -> DataFrame:
    """Least squares without intercept on two factors per group, as native sums and Cramer's rule.

    Rows lacking a value are left out, and the others winsorised at q (0 keeps them as they are); groups of fewer than
    ``least`` rows give no fit. Errors use the diagonal of X'X alone: sqrt(RSS / (n - p) / sum x^2); R2 is
    against the centred total; the factors' own R2 come from separate one-factor fits. A singular group gives NULLs.
    """
    c = df.select(by, F.col(y).alias("y"), F.col(x1).alias("a"), F.col(x2).alias("b"))
    c = winsorised_cases(c, ["y", "a", "b"], by, q) if q else c.dropna()
    s = c.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "ab", "bb", "ay", "by", "yy")], F.sum("y").alias("sy"))
    s = s.where(F.col("n") >= least)
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("b1", F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)).withColumn("b2", F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det))
    rss = F.col("yy") - F.col("b1") * F.col("ay") - F.col("b2") * F.col("by")
    tss = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    s = s.withColumn("rss", rss).withColumn("r2", 1 - F.try_divide(F.col("rss"), tss))
    error = lambda v: F.sqrt(F.try_divide(F.try_divide(F.greatest(F.col("rss"), F.lit(0.0)), F.nullif(F.col("n") - 2, F.lit(0)).cast("double")), F.col(v)))
    one = lambda v, vy: 1 - F.try_divide(F.col("yy") - F.try_divide(F.col(vy) * F.col(vy), F.col(v)), tss)
    return s.withColumn("t1", F.try_divide(F.col("b1"), error("aa"))).withColumn("t2", F.try_divide(F.col("b2"), error("bb"))).withColumn("r2_1", one("aa", "ay")).withColumn("r2_2", one("bb", "by")).select(by, "n", "b1", "b2", "t1", "t2", "r2", "r2_1", "r2_2")


def regress_many(df: DataFrame, y: str, xs: list[str], by: str, q: float = 0.01) -> DataFrame:
    """The same fit for any number of factors: sums are native, only the p by p system of a group goes to numpy."""
    clean = winsorised_cases(df.select(by, y, *xs), [y, *xs], by, q)
    p = len(xs)
    sums = clean.groupBy(by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in xs for b in xs]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in xs]).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.asarray(a).reshape(p, p), np.asarray(b), rcond=None)[0] for a, b in zip(xx, xy)])

    return sums.select(by, "n", solve("xx", "xy").alias("betas"))


def residuals(df: DataFrame, fit: DataFrame, y: str, x1: str, x2: str, by: str, q: float = 0.01) -> DataFrame:
    """What the fit leaves of the winsorised values."""
    return winsorised_cases(df, [y, x1, x2], by, q).join(fit.select(by, "b1", "b2"), by).withColumn("resid", F.col(y) - F.col("b1") * F.col(x1) - F.col("b2") * F.col(x2))


def row_blocks(df: DataFrame, order: list[str], size: int, by: str | None = None) -> DataFrame:
    """Full tumbling blocks of rows, numbered from 0; a shorter last block is dropped.

    Without ``by`` the rows are numbered over all, which suits date-level tables only.
    """
    part = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    out = df.withColumn("block", F.floor((F.row_number().over(part.orderBy(*order)) - 1) / size))
    return out.withColumn("in_", F.count("*").over(Window.partitionBy(*([by] if by else []), "block"))).where(F.col("in_") == size).drop("in_")


def factor_risk(returns: DataFrame, exposures: dict[str, float], names: list[str]) -> DataFrame:
    """Uncentred covariance of factor returns over T - 1, the variance of an exposure and each factor's share."""
    s = returns.agg((F.count("*") - 1).alias("t"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in names for b in names])
    cov = lambda a, b: F.col(f"`{a}|{b}`") / F.col("t")
    part = {a: sum((cov(a, b) * exposures[a] * exposures[b] for b in names), F.lit(0.0)) for a in names}
    return s.select(sum(part.values(), F.lit(0.0)).alias("variance"), *[part[a].alias(f"from_{a}") for a in names])


def attribution(fits: DataFrame) -> DataFrame:
    return fits.agg(*[F.avg(c).alias(f"avg_{c}") for c in ("b1", "b2", "t1", "t2", "r2")])


def factor_returns(df: DataFrame, y: str, factors: list[str], by: str = "date") -> DataFrame:
    """Slope of returns on each factor with intercept per date; fewer than four names give 0."""
    enough = F.count(F.col(y)) >= 4
    return df.groupBy(by).agg(*[F.when(enough, F.coalesce(F.regr_slope(y, f), F.lit(0.0))).otherwise(0.0).alias(f"ret_{f}") for f in factors])


def rank_ic(df: DataFrame, factor: str, ret: str, by: str = "date", name: str = "symbol") -> DataFrame:
    """Correlation of ordinal ranks per date (ties by name); NULL below three names."""
    c = df.dropna(subset=[factor, ret])
    r = c.withColumn("ra", F.row_number().over(Window.partitionBy(by).orderBy(factor, name))).withColumn("rb", F.row_number().over(Window.partitionBy(by).orderBy(ret, name)))
    return r.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr(F.col("ra").cast("double"), F.col("rb").cast("double"))).alias("ic"))


def rolling_ic(ic: DataFrame, n: int = 252, by: str = "date") -> DataFrame:
    """Mean and population deviation of the last n dates' coefficients, whatever there is of them."""
    w = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(-(n - 1), 0)  # date-level rows
    return ic.withColumn("ic_mean", F.avg("ic").over(w)).withColumn("ic_std", F.stddev_pop("ic").over(w))


def blend_weights(df: DataFrame, factors: list[str], ret: str, least: float, most: float) -> DataFrame:
    """One row of weights from pooled correlations with returns: |r| clamped to the limits, then normalised."""
    r = df.agg(*[F.coalesce(F.corr(f, ret), F.lit(0.0)).alias(f) for f in factors])
    clamped = {f: F.greatest(F.lit(least), F.least(F.lit(most), F.abs(F.col(f)))) for f in factors}
    total = sum(clamped.values(), F.lit(0.0))
    return r.select(*[F.coalesce(F.try_divide(c, total), F.lit(1.0 / len(factors))).alias(f"w_{f}") for f, c in clamped.items()])


def blend(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the factors that have a weight."""
    return df.withColumn("blend", sum((F.col(f) * w for f, w in weights.items() if f in df.columns), F.lit(0.0)))


def project(w: np.ndarray, beta: np.ndarray, gross: float, tolerance: float = 1e-6) -> np.ndarray:
    """Onto net 0, beta within tolerance, and the gross limit, in that order."""
    w = w - w.mean()
    centred = beta - beta.mean()
    if abs(w @ beta) > tolerance and centred @ centred > 0:
        w = w - centred * (w @ beta) / (centred @ centred)
        w = w - w.mean()
    size = np.abs(w).sum()
    return w * (gross / size) if size > gross else w


def mean_variance(alpha: np.ndarray, beta: np.ndarray, specific: np.ndarray, gamma: float, aversion: float, market_vol: float, gross: float, tolerance: float = 1e-10, most: int = 20_000) -> np.ndarray:
    """argmax alpha'w - gamma |w|^2 - aversion/2 w'Sw with S = market_vol^2 bb' + diag(specific^2), by projected ascent.

    S is only ever applied to w. The step is the inverse of the curvature bound.
    """
    bound = 2 * gamma + aversion * (market_vol**2 * (beta @ beta) + float(np.max(specific**2, initial=0.0)))
    step = 1 / bound if aversion > 0 and bound > 0 else 0.01
    w, last = project(np.zeros_like(alpha), beta, gross), -np.inf
    for _ in range(most):
        risk = market_vol**2 * beta * (beta @ w) + specific**2 * w
        w = project(w + step * (alpha - 2 * gamma * w - aversion * risk), beta, gross)
        risk = market_vol**2 * beta * (beta @ w) + specific**2 * w
        value = alpha @ w - gamma * (w @ w) - aversion / 2 * (w @ risk)
        if abs(value - last) < tolerance:
            break
        last = value
    return w


def optimise(df: DataFrame, gamma: float, aversion: float, market_vol: float, gross: float, by: str = "date") -> DataFrame:
    """Weights per date (or other group) from columns symbol, alpha, beta, sigma; rows lacking one are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        w = mean_variance(*[pdf[c].to_numpy(float) for c in ("alpha", "beta", "sigma")], gamma, aversion, market_vol, gross)
        return pd.DataFrame({by: pdf[by].to_numpy(), "symbol": pdf["symbol"].to_numpy(), "weight": w})

    kind = df.schema[by].dataType.simpleString()
    return spread(df.dropna(subset=["alpha", "beta", "sigma"]), by).groupBy(by).applyInPandas(run, f"{by} {kind}, symbol {df.schema['symbol'].dataType.simpleString()}, weight double")


def exposures(weights: DataFrame, by: str = "date") -> DataFrame:
    return weights.groupBy(by).agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.sum(F.col("weight") * F.col("beta")).alias("beta"))


def frontier(df: DataFrame, steps: int = 20, start: float = 0.25, ratio: float = 1.5, market_vol: float = 0.15, gross: float = 4.0, gamma: float = 0.0) -> DataFrame:
    """Efficient frontier: one optimisation per risk aversion, side by side."""
    grid = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("aversion", F.lit(start) * F.pow(F.lit(ratio), F.col("k")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        a, b, s = (pdf[c].to_numpy(float) for c in ("alpha", "beta", "sigma"))
        w = mean_variance(a, b, s, gamma, float(pdf["aversion"].iloc[0]), market_vol, gross, 1e-14)
        var = market_vol**2 * (b @ w) ** 2 + (s**2) @ (w**2)
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "aversion": [float(pdf["aversion"].iloc[0])], "alpha": [a @ w], "stdev": [var**0.5], "gross": [np.abs(w).sum()]})

    return spread(grid, "k").groupBy("k").applyInPandas(run, "k int, aversion double, alpha double, stdev double, gross double")


def regime_aversion(state: Column, levels: list[float]) -> Column:
    """Risk aversion of a regime; states outside the table take its nearest end."""
    if not levels or any(x < 0 for x in levels):
        raise ValueError("a risk aversion is needed per regime, none negative")
    return F.element_at(F.array(*[F.lit(float(x)) for x in levels]), (F.least(F.greatest(state, F.lit(0)), F.lit(len(levels) - 1)) + 1).cast("int"))


def beta_window(df: DataFrame, n: int) -> Column:
    return F.count("ret").over(rows("symbol", "date", n))
