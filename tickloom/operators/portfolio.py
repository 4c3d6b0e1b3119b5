"""Portfolio allocators and their walk-forward comparison."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.spread import spread
from tickloom.operators.validate import deflated_sharpe, sharpe_per_period


def equal(cov: np.ndarray) -> np.ndarray:
    return np.full(len(cov), 1 / len(cov))


def inverse_variance(cov: np.ndarray) -> np.ndarray:
    """Weights in inverse proportion to variance; names without variance get 0, all such names equal shares."""
    var = np.diag(cov)
    inv = np.divide(1.0, var, out=np.zeros(len(var)), where=var > 0)
    return inv / inv.sum() if inv.sum() > 0 else equal(cov)


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    w = np.linalg.pinv(cov) @ np.ones(len(cov))
    return w / w.sum() if w.sum() else equal(cov)


def _merge_order(dist: np.ndarray) -> list[int]:
    """Leaf order of single-linkage clustering; the earlier cluster stands left."""
    n = len(dist)
    leaves = {i: [i] for i in range(n)}
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = list(range(n))
    made = n
    name = {i: i for i in range(n)}
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = alive[min(i, j)], alive[max(i, j)]
        left, right = sorted((name[a], name[b]))
        leaves[made] = leaves[left] + leaves[right]
        d[a] = np.minimum(d[a], d[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        alive.remove(b)
        name[a] = made
        made += 1
    return leaves[name[alive[0]]]


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on the correlation distance, then risk split down the ordered halves."""
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.clip(np.nan_to_num(cov / np.outer(sd, sd)), -1, 1)
    half = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    order = _merge_order(half)
    w, parts = np.ones(len(cov)), [order]
    while parts:
        parts = [h for p in parts if len(p) > 1 for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        for a, b in zip(parts[::2], parts[1::2]):
            va, vb = (float(inverse_variance(cov[np.ix_(p, p)]) @ cov[np.ix_(p, p)] @ inverse_variance(cov[np.ix_(p, p)])) for p in (a, b))
            share = 1 - va / (va + vb) if va + vb > 0 else 0.5
            w[a] *= share
            w[b] *= 1 - share
    return w / w.sum()


ALLOCATORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"equal": equal, "ivp": inverse_variance, "mvo": minimum_variance, "hrp": hierarchical}


def walk_forward(vectors: DataFrame, lookback: int, hold: int, allocators: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(allocator, rebalance, date, ret, turnover): books set on the last ``lookback`` rows, held for ``hold``.

    vectors: (date, r). Each rebalance is a group holding its own look-back and holding rows, so they run side
    by side; a last block that is not full is dropped. Turnover is the sum of absolute changes, on the first date of
    a block.
    """
    table = allocators or ALLOCATORS
    v = vectors.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # date-level rows
    n = v.agg(F.count("*").alias("n_"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - lookback - hold + 1) / hold)), F.floor(F.col("i") / hold)
    g = v.withColumn("n_", n.scalar()).withColumn("rebalance", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    start = F.col("rebalance") * hold + lookback
    g = g.where((F.col("i") >= start - lookback) & (F.col("i") < start + hold) & (start + hold <= F.col("n_"))).withColumn("past", F.col("i") < start)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = np.stack([np.asarray(r) for r in pdf["r"]])
        past = pdf["past"].to_numpy()
        cov = np.cov(x[past], rowvar=False)
        out = []
        for name, f in table.items():
            w = f(cov)
            out += [(name, int(pdf["rebalance"].iloc[0]), d, float(r), w.tolist()) for d, r in zip(pdf["date"].to_numpy()[~past], x[~past] @ w)]
        return pd.DataFrame(out, columns=["allocator", "rebalance", "date", "ret", "w"])

    kind = vectors.schema["date"].dataType.simpleString()
    done = spread(g, "rebalance").groupBy("rebalance").applyInPandas(run, f"allocator string, rebalance int, date {kind}, ret double, w array<double>")
    w = Window.partitionBy("allocator").orderBy("date")
    change = F.aggregate(F.zip_with("w", F.coalesce(F.lag("w").over(w), F.array_repeat(F.lit(0.0), F.size("w"))), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return done.withColumn("turnover", change).drop("w")


def allocator_scores(walk: DataFrame, periods: int = 252, groups: int = 6) -> DataFrame:
    """Annual Sharpe ratio and volatility per allocator, mean turnover of its rebalances after the first, mean, deviation and least of its Sharpe ratios per period over
    ``groups`` contiguous blocks of dates, and for the best allocator its Sharpe ratio deflated by the choice among all."""
    place = F.row_number().over(Window.partitionBy("allocator").orderBy("date")) - 1
    w = walk.withColumn("i", place).withColumn("n_", F.count("*").over(Window.partitionBy("allocator")))
    size, longer = F.floor(F.col("n_") / groups), F.col("n_") % groups
    cut = longer * (size + 1)
    w = w.withColumn("grp", F.when(F.col("i") < cut, F.floor(F.col("i") / (size + 1))).otherwise(longer + F.floor((F.col("i") - cut) / F.greatest(size, F.lit(1)))).cast("int"))
    b = sharpe_per_period(w, "ret", ["allocator", "grp"]).groupBy("allocator").agg(F.avg("sharpe").alias("block_mean"), F.stddev_samp("sharpe").alias("block_sd"), F.min("sharpe").alias("block_min"))
    a = walk.groupBy("allocator").agg((F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * periods**0.5).alias("sharpe"), (F.stddev_samp("ret") * periods**0.5).alias("vol"), F.countDistinct("rebalance").alias("rebalances"))
    moved = walk.where("rebalance > 0").groupBy("allocator", "rebalance").agg(F.sum("turnover").alias("t")).groupBy("allocator").agg(F.avg("t").alias("turnover"))
    a = a.join(moved, "allocator", "left").fillna({"turnover": 0.0})
    best = deflated_sharpe(walk, "ret", "allocator").select("allocator", F.col("dsr").alias("best_dsr"))
    return a.join(b, "allocator").join(best, "allocator", "left")
