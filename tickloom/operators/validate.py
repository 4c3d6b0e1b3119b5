"""Purged cross-validation, probabilistic and deflated Sharpe ratios, and a registry of trials."""

from __future__ import annotations

import functools
import hashlib
import json
import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import let, normal_cdf, normal_ppf
from tickloom.functions.running import running

EULER = 0.5772156649015329
BUCKETS = 64  # stretches of the axis that are walked side by side
WINDOW, ROW = 0, 1


def label_windows(rows: DataFrame, holding: int, idx: str = "idx") -> DataFrame:
    return rows.withColumn("t0", F.col(idx)).withColumn("t1", F.col(idx) + holding)


def group_of(idx: Column, n: int, groups: int) -> Column:
    """Group of a row when n rows are cut into contiguous groups, the first n mod groups one longer."""
    size, longer = n // groups, n % groups
    cut = longer * (size + 1)
    return F.when(idx < cut, F.floor(idx / (size + 1))).otherwise(longer + F.floor((idx - cut) / max(size, 1))).cast("int")


def splits(spark: SparkSession, groups: int, k: int) -> DataFrame:
    """(split_id, grp, path): the test groups of all choices of k, and the path each serves."""
    met = dict.fromkeys(range(groups), 0)
    rows = []
    for i, chosen in enumerate(combinations(range(groups), k)):
        for g in chosen:
            rows.append((i, g, met[g]))
            met[g] += 1
    return spark.createDataFrame(rows, "split_id int, grp int, path int")


def paths(groups: int, k: int) -> int:
    return math.comb(groups - 1, k - 1)


def purged_train(rows: DataFrame, spark: SparkSession, n: int, groups: int, k: int, embargo: float = 0.0, bars: int | None = None) -> DataFrame:
    """(split_id, idx, role) with role test, train, purged or embargoed for every split.

    With ``bars``, idx numbers events in order of start while t0 and t1 are bars: the embargo then lies on the bar
    axis, and an event is embargoed if its t0 lies within int(bars embargo) bars after a test window ends.

    rows: (idx, t0, t1). A training row is purged if its window meets any test window (ends included), and
    embargoed if it starts within int(n embargo) rows after a test window ends. Both are told by two values per group,
    not per split: the latest end among its windows that start by the row's own end (it meets the row if it reaches the
    row's start), and the last end before the row. These are running maxima over all rows, in buckets of the axis with
    a carry between them; only the roles are then spread over the splits.
    """
    chosen = list(combinations(range(groups), k))
    size = max(1, -(-(n if bars is None else max(bars, 1)) // BUCKETS))
    gap = int((n if bars is None else bars) * embargo)
    r = rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("idx", "t0", "t1")]).withColumn("grp", group_of(F.col("idx"), n, groups))
    r = r.withColumn("at", F.col("idx") if bars is None else F.col("t0"))
    of = lambda g: F.when((F.col("kind") == WINDOW) & (F.col("grp") == g), F.col("t1"))

    def told(asked: DataFrame, x: Column, start: Column, first: bool, name: str) -> DataFrame:
        """Per asked row the largest t1 of each group's windows whose ``start`` lies by (first) or before its x."""
        both = asked.withColumn("kind", F.lit(ROW)).withColumn("x", x).withColumn("late", F.lit(int(first)))
        own = r.select(*[F.col(c) if c in r.columns else F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns]).withColumn("kind", F.lit(WINDOW)).withColumn("x", start).withColumn("late", F.lit(int(not first)))
        done = running(both.unionByName(own), [], ["x", "late"], F.floor(F.col("x") / size), maxima={f"m{g}": of(g) for g in range(groups)})
        return done.where(F.col("kind") == ROW).withColumn(name, F.array(*[f"m{g}" for g in range(groups)])).select(*asked.columns, name)

    met = told(told(r, F.col("t1"), F.col("t0"), True, "reach"), F.col("at"), F.col("t1"), False, "ended")
    roles = []
    for i, c in enumerate(chosen):
        purged = [F.coalesce(F.col("reach")[g] >= F.col("t0"), F.lit(False)) for g in c]
        late = [F.coalesce(F.col("ended")[g] + gap >= F.col("at"), F.lit(False)) for g in c]
        any_ = lambda xs: functools.reduce(lambda a, b: a | b, xs)
        role = F.when(F.col("grp").isin(*c), "test").when(any_(purged), "purged").when(any_(late), "embargoed").otherwise("train")
        roles.append(F.struct(F.lit(i).alias("split_id"), role.alias("role")))
    return met.select("idx", F.explode(F.array(*roles)).alias("s")).select("s.split_id", "idx", "s.role")


def sharpe_per_period(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """n, Sharpe ratio, skewness and (non-excess) kurtosis per group, of finite values; without spread 0, 0 and 3."""
    c = df.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    m = c.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku"))
    flat = F.coalesce(F.col("sd") == 0, F.lit(True))
    return m.select(*by, "n", F.when(flat, 0.0).otherwise(F.col("m") / F.nullif("sd", F.lit(0.0))).alias("sharpe"), F.when(flat, 0.0).otherwise(F.col("sk")).alias("skew"), F.when(flat, 3.0).otherwise(F.col("ku") + 3).alias("kurt"))


def probabilistic_sharpe(sharpe: Column, against: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """P(true Sharpe > against); 0.5 below two values, NULL where the variance formula breaks down."""
    v = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    return F.when(n < 2, 0.5).when(v > 0, let((sharpe - against) * F.sqrt(n - 1) / F.sqrt(F.when(v > 0, v)), normal_cdf))


def expected_best(variance: Column, trials: Column) -> Column:
    """Expected largest Sharpe ratio among independent trials without skill; 0 for one trial."""
    t = F.when(trials > 1, trials.cast("double"))
    return F.coalesce(F.sqrt(variance) * ((1 - EULER) * normal_ppf(1 - 1 / t) + EULER * normal_ppf(1 - 1 / (t * math.e))), F.lit(0.0))


def deflated_sharpe(trials: DataFrame, x: str, by: str = "trial_id") -> DataFrame:
    """One row: the best trial, its Sharpe ratio, the expected best without skill, PSR and DSR."""
    s = sharpe_per_period(trials, x, [by])
    a = s.agg(F.max_by(F.struct(by, "n", "sharpe", "skew", "kurt"), F.struct("sharpe", by)).alias("b"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v"), F.count("*").alias("trials"))
    bar = expected_best(F.col("v"), F.col("trials"))
    psr = lambda against: probabilistic_sharpe(F.col("b.sharpe"), against, F.col("b.n"), F.col("b.skew"), F.col("b.kurt"))
    return a.withColumn("bar", bar).select(F.col(f"b.{by}").alias(by), F.col("b.sharpe").alias("sharpe"), "trials", F.col("bar").alias("expected_best"), psr(F.lit(0.0)).alias("psr"), psr(F.col("bar")).alias("dsr"))


def deflated_trials(trials: DataFrame, x: str, by: str = "trial_id") -> DataFrame:
    """Every trial with its Sharpe ratio per period, PSR, and DSR against the expected best of all of them."""
    s = sharpe_per_period(trials, x, [by])
    a = s.agg(expected_best(F.coalesce(F.var_samp("sharpe"), F.lit(0.0)), F.count("*")).alias("bar"))
    psr = lambda against: probabilistic_sharpe(F.col("sharpe"), against, F.col("n"), F.col("skew"), F.col("kurt"))
    return s.withColumn("bar", a.scalar()).select(by, "n", "sharpe", F.col("bar").alias("expected_best"), psr(F.lit(0.0)).alias("psr"), psr(F.col("bar")).alias("dsr"))


def noise_trials(spark: SparkSession, trials: int = 100, length: int = 250, seed: int = 7) -> DataFrame:
    """Returns without skill, from numpy's generator: (trial_id, idx, ret). Bounded by its arguments."""
    x = np.random.default_rng(seed).standard_normal((trials, length)) * 0.01
    return spark.createDataFrame([(f"t{i:03d}", j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "trial_id string, idx int, ret double")


def trial_id(params: dict) -> str:
    return hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest()[:12]


class TrialRegistry:
    """Trials as partitioned tables; storing equal parameters again replaces the trial."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def store(self, params: dict, returns: DataFrame) -> str:
        t = trial_id(params)
        meta = self.spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/trials/trial_id={t}")
        returns.write.mode("overwrite").parquet(f"{self.folder}/returns/trial_id={t}")
        return t

    def trials(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/trials")

    def returns(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/returns")


def block_sharpes(returns: DataFrame, x: str, n: int, groups: int, by: list[str], idx: str = "idx") -> DataFrame:
    return sharpe_per_period(returns.withColumn("grp", group_of(F.col(idx), n, groups)), x, [*by, "grp"])
