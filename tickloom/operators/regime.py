"""Market regimes: a causal Gaussian hidden Markov model and debounced states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import rows
from tickloom.functions.spread import spread

FLOOR = 1e-6
LEAST = 1e-300  # of a chance, before its logarithm is taken


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None, :] - mean[None]) ** 2 / var[None]).sum(axis=2)


def _scaled(log_density: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities over the largest of each row, and the logarithms taken out."""
    top = log_density.max(axis=1)
    return np.exp(log_density - top[:, None]), top


class GaussianHmm:
    """Diagonal Gaussian states, fitted by expectation maximisation from a seeded k-means start and equal chances.

    Recursions run on chances scaled to 1 at each step, which loses nothing against logarithms since every chance of a
    move is kept above LEAST.
    """

    def __init__(self, states: int, seed: int = 0, rounds: int = 100, tolerance: float = 1e-4) -> None:
        self.k, self.seed, self.rounds, self.tolerance = states, seed, rounds, tolerance

    def _start(self, x: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        self.mean = x[rng.choice(len(x), self.k, replace=False)]
        near = np.zeros(len(x), int)
        for _ in range(25):
            new = ((x[:, None] - self.mean[None]) ** 2).sum(axis=2).argmin(axis=1)
            if np.array_equal(new, near):
                break
            near = new
            self.mean = np.array([x[near == j].mean(axis=0) if np.any(near == j) else self.mean[j] for j in range(self.k)])
        self.var = np.array([np.maximum(x[near == j].var(axis=0), FLOOR) if np.any(near == j) else np.ones(x.shape[1]) for j in range(self.k)])
        self.start = np.full(self.k, 1 / self.k)
        self.move = np.full((self.k, self.k), 1 / self.k)

    def _forward(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered chances per row, and the scale of each step."""
        move = np.maximum(self.move, LEAST)
        out, scale = np.empty_like(d), np.empty(len(d))
        a = np.maximum(self.start, LEAST) * d[0]
        for t in range(len(d)):
            if t:
                a = (a @ move) * d[t]
            scale[t] = s = a.sum()
            a = out[t] = a / s
        return out, scale

    def fit(self, x: np.ndarray) -> GaussianHmm:
        self._start(x)
        last = -np.inf
        for _ in range(self.rounds):
            d, top = _scaled(_log_density(x, self.mean, self.var))
            move = np.maximum(self.move, LEAST)
            f, scale = self._forward(d)
            back = np.ones_like(d)
            g, ahead, turned = back[-1], d / scale[:, None], move.T.copy()
            for t in range(len(d) - 2, -1, -1):
                g = back[t] = (ahead[t + 1] * g) @ turned
            like = float(np.log(scale).sum() + top.sum())
            post = f * back
            xi = move * (f[:-1].T @ (ahead[1:] * back[1:]))
            weight = post.sum(axis=0)
            self.start = post[0] / post[0].sum()
            self.move = xi / np.maximum(xi.sum(axis=1, keepdims=True), LEAST)
            self.mean = post.T @ x / weight[:, None]
            self.var = np.maximum(np.stack([(post[:, j, None] * (x - self.mean[j]) ** 2).sum(axis=0) / weight[j] for j in range(self.k)]), FLOOR)
            if like - last < self.tolerance:
                break
            last = like
        return self

    def filter(self, x: np.ndarray) -> np.ndarray:
        """P(state at t | observations up to t)."""
        return self._forward(_scaled(_log_density(x, self.mean, self.var))[0])[0]


def causal_states(features: DataFrame, columns: list[str], states: int = 3, warm: int = 252, every: int = 63, seed: int = 0, order: str = "date") -> DataFrame:
    """(date, state, p_state_0, ...): filtered regime per date, from models refitted every ``every`` dates.

    The first date with a state is the warm-th; a model is fitted on the dates up to its own first one, standardised by
    their mean and sample deviation, and filters through to the next refit. States are ordered by the first column's
    mean. Fewer dates than warm give no rows.

    Refits run side by side. The date-level table is gathered once, a row a date, and reaches the tasks as one value, so
    that only the refits' numbers are shuffled.
    """
    names = [f"p_state_{j}" for j in range(states)]
    kind = features.schema[order].dataType.simpleString()
    line = features.select(F.struct(F.col(order).alias("at"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).alias("r"))
    line = line.agg(F.sort_array(F.collect_list("r")).alias("rows"))  # date-level rows
    refits = F.floor((F.size("rows") - warm) / every).cast("int")
    segments = line.where(F.size("rows") >= warm).select(F.explode(F.sequence(F.lit(0), refits)).alias("seg"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows_, seg in zip(pdf["rows"], pdf["seg"]):
                at = [r["at"] for r in rows_]
                x = np.stack([np.asarray(r["x"], float) for r in rows_])
                first = warm - 1 + seg * every
                end = min(first + every, len(x))
                past = x[: first + 1]
                m, s = past.mean(axis=0), past.std(axis=0, ddof=1)
                s[s == 0] = 1.0
                model = GaussianHmm(states, seed).fit((past - m) / s)
                p = model.filter((x[:end] - m) / s)[first:, np.argsort(model.mean[:, 0], kind="stable")]
                yield pd.DataFrame({order: at[first:end], "state": p.argmax(axis=1).astype("int32"), **{n: p[:, j] for j, n in enumerate(names)}})

    return spread(segments).withColumn("rows", line.scalar()).mapInPandas(run, f"{order} {kind}, state int, {', '.join(f'{n} double' for n in names)}")


def debounced(states: DataFrame, dwell: int, least: float = 0.0, by: str = "series", order: str = "date") -> DataFrame:
    """A state is committed once it has qualified (p >= least) on ``dwell`` rows running; until then the one before,
    at first the first row's, stays."""
    w = Window.partitionBy(by).orderBy(order)
    s = states.withColumn("i_", F.row_number().over(w) - 1).withColumn("ok_", F.coalesce(F.col("p") >= least, F.lit(False)))
    new = (~F.col("ok_")) | (~F.lag("ok_", 1, False).over(w)) | (~F.col("state").eqNullSafe(F.lag("state").over(w)))
    s = s.withColumn("isle", F.sum(new.cast("int")).over(w))
    s = s.withColumn("run", F.when(F.col("ok_"), F.row_number().over(Window.partitionBy(by, "isle").orderBy(order))).otherwise(0))
    done = F.when((F.col("run") >= dwell) & (F.col("i_") > 0), F.col("state"))
    first = F.first("state").over(rows(by, order))
    return s.withColumn("committed", F.coalesce(F.last(done, ignorenulls=True).over(rows(by, order)), first)).drop("i_", "ok_", "isle", "run")


def regime_stats(states: DataFrame, column: str, by: str = "series", order: str = "date", means: tuple[str, ...] = ()) -> DataFrame:
    """Occupancy of each state, the number of switches into it, and the means of further columns in it."""
    w = Window.partitionBy(by).orderBy(order)
    moved = (F.col(column) != F.lag(column).over(w)).cast("int")
    s = states.withColumn("m", F.coalesce(moved, F.lit(0))).groupBy(by, column).agg(F.count("*").alias("rows"), F.sum("m").alias("entered"), *[F.avg(c).alias(f"mean_{c}") for c in means])
    return s.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(by)))
