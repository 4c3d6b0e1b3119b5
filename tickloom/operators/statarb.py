"""Statistical arbitrage: rolling principal components, mean-reverting residuals and their books."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import rows
from tickloom.functions.spread import spread


def noise_edge(names: int, window: int) -> float:
    """Largest eigenvalue that pure noise would show in a correlation matrix."""
    return (1 + (names / window) ** 0.5) ** 2


def vectors(returns: DataFrame) -> DataFrame:
    """(date, names, r): one row per date with the returns of all names in order; incomplete dates are dropped."""
    v = returns.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("symbol", "ret"))).alias("v"))
    widest = v.agg(F.max(F.size("v")).alias("most"))
    v = v.where(F.size("v") == widest.scalar())
    return v.select("date", F.col("v.symbol").alias("names"), F.col("v.ret").alias("r"))


def segments(v: DataFrame, n: int, length: int | None = None) -> DataFrame:
    """Dates cut into stretches, each with the n - 1 dates before it: (seg, i, date, names, r), spread by seg.

    Only the dates are numbered in one place. Windows of n dates that end in a stretch lie within it.
    """
    length = length or max(128, 2 * n)
    place = v.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("i"))  # date-level rows
    last = F.floor((F.col("i") + n - 1) / length)
    own = F.floor(F.col("i") / length)
    cut = v.join(place, "date").withColumn("seg", F.explode(F.sequence(own, last)))
    return spread(cut, "seg").withColumn("length", F.lit(length))


def components(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (descending), loadings (columns, oriented to a positive sum) and deviations of a window."""
    sd = x.std(axis=0, ddof=1)
    if np.any(sd == 0):
        raise ValueError("a name has no variance in the window")
    value, vector = np.linalg.eigh(np.corrcoef(x, rowvar=False))
    value, vector = value[::-1], vector[:, ::-1]
    total = vector.sum(axis=0)
    lead = vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])]
    sign = np.where(np.abs(total) > 1e-12, np.sign(total), np.sign(lead))
    return value, vector * sign, sd


def keep_components(values: np.ndarray, window: int, rule: str, arg: float) -> int:
    """How many components count: above the noise edge (mp), a fixed number, or up to a share of variance."""
    if rule == "fixed":
        return min(int(arg), len(values))
    if rule == "variance":
        return int(np.searchsorted(np.cumsum(values) / values.sum(), arg) + 1)
    return int((values > noise_edge(len(values), window)).sum())


def overlap(resid: np.ndarray, factors: np.ndarray) -> float:
    """Largest absolute correlation between a residual and a factor: 0 up to rounding, and without factors."""
    if not factors.shape[1]:
        return 0.0
    r, f = resid - resid.mean(axis=0), factors - factors.mean(axis=0)
    return float(np.abs((r / (np.linalg.norm(r, axis=0) + 1e-300)).T @ (f / (np.linalg.norm(f, axis=0) + 1e-300))).max())


def residual_paths(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of all names on the eigenportfolios, R2, and beta to the first (NaN without components)."""
    return _regressed(x, *components(x)[1:], count)[:3]


def _regressed(x: np.ndarray, vector: np.ndarray, sd: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    factors = x @ (vector[:, :count] / sd[:, None])
    design = np.column_stack([np.ones(len(x)), factors])
    coef, *_ = np.linalg.lstsq(design, x, rcond=None)
    resid = x - design @ coef
    total = ((x - x.mean(axis=0)) ** 2).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(total > 0, 1 - (resid**2).sum(axis=0) / total, np.nan)
    return resid, r2, coef[1] if count else np.full(x.shape[1], np.nan), factors


def _each_window(cut: DataFrame, n: int, of: Callable[[np.ndarray, list[str]], dict[str, object]], schema: str) -> DataFrame:
    """Rows ``of`` makes from every window of n dates, with its last date; windows in which a name stands still give none."""
    kind = cut.schema["date"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, at = np.stack([np.asarray(r, float) for r in pdf["r"]]), pdf["i"].to_numpy()
        first = int(pdf["seg"].iloc[0]) * int(pdf["length"].iloc[0])
        out = []
        for t in range(n - 1, len(x)):
            window = x[t - n + 1 : t + 1]
            if at[t] >= first and np.all(window.std(axis=0) > 0):
                out.append({"date": pdf["date"].iloc[t], **of(window, list(pdf["names"].iloc[t]))})
        return pd.DataFrame(out, columns=["date", *[c.split()[0] for c in schema.split(", ")]])

    return cut.groupBy("seg").applyInPandas(run, f"date {kind}, {schema}")


def spectrum(v: DataFrame, n: int, rule: str = "mp", arg: float = 0.0, share: float = 0.55) -> DataFrame:
    """Per date the window's eigenvalues, how many count by the noise edge and by a share of variance, how many are kept by
    ``rule``, and the returns of their eigenportfolios on the date."""

    def of(x: np.ndarray, names: list[str]) -> dict[str, object]:
        value, vector, sd = components(x)
        k = keep_components(value, n, rule, arg)
        return {"eigenvalues": value.tolist(), "kept_mp": keep_components(value, n, "mp", 0.0), "kept_variance": keep_components(value, n, "variance", share), "kept": k, "factor_returns": (x[-1] @ (vector[:, :k] / sd[:, None])).tolist()}

    return _each_window(segments(v, n), n, of, "eigenvalues array<double>, kept_mp int, kept_variance int, kept int, factor_returns array<double>")


def factor_rows(spectra: DataFrame) -> DataFrame:
    """(date, factor, ret), factors numbered from 1."""
    return spectra.select("date", F.posexplode("factor_returns").alias("factor", "ret")).withColumn("factor", F.col("factor") + 1)


def rolling_residuals(v: DataFrame, n: int, rule: str = "mp", arg: float = 0.0) -> DataFrame:
    """(date, symbol, path, r2, beta, overlap): each name's cumulative residual over the window ending at the date.

    Each window is decomposed once; ``overlap`` is the largest correlation of its residuals with its factors.
    """

    def of(x: np.ndarray, names: list[str]) -> dict[str, object]:
        value, vector, sd = components(x)
        resid, r2, beta, factors = _regressed(x, vector, sd, keep_components(value, n, rule, arg))
        path = np.cumsum(resid, axis=0).T.tolist()
        return {"res": [{"symbol": s, "path": p, "r2": float(a), "beta": float(b)} for s, p, a, b in zip(names, path, r2, beta)], "overlap": overlap(resid, factors)}

    kind = v.schema["names"].dataType.elementType.simpleString()
    # a list of objects per date, not commas at the top level of the schema
    e = _each_window(segments(v, n), n, of, f"res array<struct<symbol:{kind},path:array<double>,r2:double,beta:double>>, overlap double")
    return e.select("date", F.explode("res").alias("z"), "overlap").select("date", "z.symbol", "z.path", "z.r2", "z.beta", "overlap")


def reversion(paths: DataFrame, dt: float = 1 / 252, speed: float = 0.5) -> DataFrame:
    """Autoregressive fit of each path and its s-score, natively on the array.

    Valid if 0 < b < 1 and the residual variance is positive; the score is NULL for invalid and for slow ones, whose
    half-life exceeds ``speed`` times the window.
    """
    p = F.col("path")
    n = (F.size(p) - 1).cast("double")
    x, y = F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    s = paths.withColumn("n_", n).withColumn("sx", total(x)).withColumn("sy", total(y)).withColumn("sxx", dot(x, x)).withColumn("sxy", dot(x, y)).withColumn("syy", dot(y, y)).withColumn("last", F.element_at(p, -1))
    cxx, cxy, cyy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n_"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n_"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n_")
    s = s.withColumn("b", F.try_divide(cxy, cxx)).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n_")).withColumn("var", F.greatest(cyy - F.col("b") * cxy, F.lit(0.0)) / F.greatest(F.col("n_") - 2, F.lit(1.0)))
    valid = (F.col("b") > 0) & (F.col("b") < 1) & (F.col("var") > 0)
    b = F.when(valid, F.col("b"))
    s = s.withColumn("kappa", -F.log(b) / dt).withColumn("mean", F.col("a") / (1 - b)).withColumn("sigma_eq", F.sqrt(F.col("var") / (1 - b * b))).withColumn("tau", -1 / F.log(b))
    fast = F.col("tau") < speed * F.size("path")
    return s.withColumn("s", F.when(fast, (F.col("last") - F.col("mean")) / F.col("sigma_eq"))).drop("n_", "sx", "sy", "sxx", "sxy", "syy", "path")


def banded_positions(scores: DataFrame, open_long: float = -1.25, open_short: float = 1.25, close_long: float = -0.5, close_short: float = 0.75, by: str = "symbol", order: str = "date") -> DataFrame:
    """Positions with separate entry and exit bands, as windows.

    Below open_long a long opens, above open_short a short; a long is held while s <= close_long, a short while
    s >= close_short, else the book is flat; a NULL score is flat. A score may flip a position at once. A row is long
    if it opens one, or lies in the holding zone with nothing but holding rows since the last opening.
    """
    s, w = F.col("s"), rows(by, order)
    i = F.row_number().over(Window.partitionBy(by).orderBy(order))
    o = scores.withColumn("i_", i)
    at = lambda cond: F.max(F.when(cond, F.col("i_"))).over(w)
    opens_l, opens_s = s < open_long, s > open_short
    breaks_l, breaks_s = s.isNull() | (s > close_long), s.isNull() | (s < close_short)
    o = o.withColumn("ol", at(opens_l)).withColumn("bl", F.coalesce(at(breaks_l), F.lit(0))).withColumn("os", at(opens_s)).withColumn("bs", F.coalesce(at(breaks_s), F.lit(0)))
    return o.withColumn("pos", F.when(F.col("ol") > F.col("bl"), 1).when(F.col("os") > F.col("bs"), -1).otherwise(0)).drop("i_", "ol", "bl", "os", "bs")


def neutral_weights(positions: DataFrame, gross: float = 1.0, by: str = "date") -> DataFrame:
    """Half the gross on each side, equally; a date with one side only stays flat."""
    w = Window.partitionBy(by)
    longs, shorts = F.sum(F.when(F.col("pos") > 0, 1).otherwise(0)).over(w), F.sum(F.when(F.col("pos") < 0, 1).otherwise(0)).over(w)
    both = (longs > 0) & (shorts > 0)
    return positions.withColumn("weight", F.when(both & (F.col("pos") > 0), gross / 2 / F.nullif(longs, F.lit(0))).when(both & (F.col("pos") < 0), -gross / 2 / F.nullif(shorts, F.lit(0))).otherwise(0.0))


def book_diagnostics(weights: DataFrame, by: str = "date") -> DataFrame:
    """Net, gross, names per side, and half the absolute change against the date before (the first from flat)."""
    prev = F.lag("weight", 1, 0.0).over(Window.partitionBy("symbol").orderBy(by))
    return weights.withColumn("d", F.abs(F.col("weight") - prev)).groupBy(by).agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.count_if(F.col("weight") > 0).alias("longs"), F.count_if(F.col("weight") < 0).alias("shorts"), (F.sum("d") / 2).alias("turnover"))


def paper_pnl(weights: DataFrame, returns: DataFrame, lag: int = 1, by: str = "date") -> DataFrame:
    """Sum of returns times the weights set lag + 1 dates before, on the grid of the returns."""
    met = returns.join(weights.select(by, "symbol", "weight"), [by, "symbol"], "left")
    held = F.lag("weight", lag + 1).over(Window.partitionBy("symbol").orderBy(by))
    return met.withColumn("pnl", F.coalesce(held * F.col("ret"), F.lit(0.0))).groupBy(by).agg(F.sum("pnl").alias("pnl"))


def active_sharpe(pnl: DataFrame, x: str = "pnl", periods: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """Sharpe ratio over the dates with a profit or loss."""
    return pnl.where(F.col(x) != 0).groupBy(*by).agg(F.count("*").alias("days"), (F.try_divide(F.avg(x), F.stddev_samp(x)) * periods**0.5).alias("sharpe"))


def grid_pnl(weights: DataFrame, returns: DataFrame, configs: int) -> DataFrame:
    """(config, date, pnl): paper profit of ``configs`` books side by side, on the grid of the returns."""
    met = returns.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(configs - 1)))).join(weights.select("config", "date", "symbol", "weight"), ["config", "date", "symbol"], "left")
    held = F.lag("weight", 2).over(Window.partitionBy("config", "symbol").orderBy("date"))
    return met.withColumn("x", F.coalesce(held * F.col("ret"), F.lit(0.0))).groupBy("config", "date").agg(F.sum("x").alias("pnl"))


def band_sweep(scores: DataFrame, returns: DataFrame, bands: list[tuple[float, float, float, float]], windows: list[int] | None = None) -> DataFrame:
    """Sharpe of the book for each set of bands; the scores are computed once and joined with the grid.

    With windows, scores carry a column ``window`` and every set of bands meets every window: config is the number of
    the bands times that of the windows, plus the window's place.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("config"), *[F.lit(float(v)).alias(n) for v, n in zip(b, ("ol_", "os_", "cl_", "cs_"))]) for i, b in enumerate(bands)])
    s = scores.withColumn("g", F.explode(grid)).select("*", "g.*").drop("g")
    if windows:
        place = F.array_position(F.array(*[F.lit(w) for w in windows]), F.col("window")).cast("int")
        s = s.where(place > 0).withColumn("config", F.col("config") * len(windows) + place - 1)
    s = s.withColumn("key", F.concat_ws("|", "config", "symbol"))
    # bands enter as columns, so that one plan serves all configurations
    i = F.row_number().over(Window.partitionBy("key").orderBy("date"))
    w = rows("key", "date")
    o = s.withColumn("i_", i)
    at = lambda cond: F.max(F.when(cond, F.col("i_"))).over(w)
    sc = F.col("s")
    ol, bl = at(sc < F.col("ol_")), F.coalesce(at(sc.isNull() | (sc > F.col("cl_"))), F.lit(0))
    os, bs = at(sc > F.col("os_")), F.coalesce(at(sc.isNull() | (sc < F.col("cs_"))), F.lit(0))
    o = o.withColumn("pos", F.when(ol > bl, 1).when(os > bs, -1).otherwise(0)).withColumn("cell", F.concat_ws("|", "config", "date"))
    weights = neutral_weights(o, by="cell").select("config", "date", "symbol", "weight")
    return active_sharpe(grid_pnl(weights, returns, len(bands) * len(windows or [0])), by=("config",))
