"""Meta-labelling: events, barriers, uniqueness, a logistic model and the sizing of bets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import rows
from tickloom.functions.spread import spread


def entries(positions: DataFrame, by: str = "symbol", order: str = "idx") -> DataFrame:
    """Rows on which a position is opened or turned."""
    prev = F.lag("pos", 1, 0).over(Window.partitionBy(by).orderBy(order))
    return positions.withColumn("prev_", prev).where("pos <> 0 AND pos <> prev_").drop("prev_")


def triple_barrier(prices: DataFrame, events: DataFrame, gain: float, loss: float, horizon: int, by: str = "symbol") -> DataFrame:
    """Per event: label, signed return and end. The first row at which the signed return reaches a barrier decides;
    none within the horizon, its last row does by sign. Events start at idx; the horizon stops at the last price.

    An event meets only the rows of its own horizon: rows are put in bins as long as the horizon, an event looks
    into two of them.
    """
    p = prices.select(by, F.col("idx").alias("i"), F.col("close").alias("p"), F.floor(F.col("idx") / horizon).alias("bin"))
    e = events.select(by, F.col("idx").alias("t0"), F.col("pos").alias("side"), F.col("close").alias("p0"))
    e = e.withColumn("bin", F.explode(F.sequence(F.floor((F.col("t0") + 1) / horizon), F.floor((F.col("t0") + horizon) / horizon))))
    met = e.join(p, [by, "bin"]).where((F.col("i") > F.col("t0")) & (F.col("i") <= F.col("t0") + horizon))
    r = F.col("side") * (F.col("p") / F.col("p0") - 1)
    met = met.withColumn("r", r).withColumn("hit", F.when(F.col("r") >= gain, 1).when(F.col("r") <= -loss, 0))
    g = met.groupBy(by, "t0", "side").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("i", "hit", "r"))).alias("touch"), F.max(F.struct("i", "r")).alias("end"))
    return g.select(by, "t0", "side", F.coalesce("touch.i", "end.i").alias("t1"), F.coalesce("touch.r", "end.r").alias("ret"), F.coalesce("touch.hit", (F.col("end.r") > 0).cast("int")).alias("label"))


def concurrency(labels: DataFrame, by: str = "symbol") -> DataFrame:
    """How many label windows are open at each row: a running sum of openings and closings, then the rows between."""
    d = labels.select(by, F.explode(F.array(F.struct(F.col("t0").alias("i"), F.lit(1).alias("d")), F.struct((F.col("t1") + 1).alias("i"), F.lit(-1).alias("d")))).alias("x")).groupBy(by, "x.i").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(by).orderBy("i")
    s = d.withColumn("open", F.sum("d").over(w)).withColumn("until", F.lead("i").over(w) - 1).where("open > 0")
    return s.select(by, F.explode(F.sequence("i", "until")).alias("i"), "open")


def uniqueness(labels: DataFrame, by: str = "symbol") -> DataFrame:
    """Mean of 1 / concurrency over each label's window, from prefix sums of it."""
    c = concurrency(labels, by).withColumn("inv", F.sum(1 / F.col("open")).over(rows(by, "i")))
    a = labels.join(c.select(by, F.col("i").alias("t1"), F.col("inv").alias("hi")), [by, "t1"])
    first = c.select(by, F.col("i").alias("t0"), F.col("inv").alias("lo"), (1 / F.col("open")).alias("own"))
    return a.join(first, [by, "t0"]).withColumn("uniqueness", (F.col("hi") - F.col("lo") + F.col("own")) / (F.col("t1") - F.col("t0") + 1)).drop("hi", "lo", "own")


def sample_weights(labels: DataFrame, by_return: bool = False) -> DataFrame:
    """Uniqueness (times the absolute return), scaled to a mean of 1 over all labels."""
    w = F.col("uniqueness") * (F.abs("ret") if by_return else F.lit(1.0))
    total = labels.agg(F.avg(w).alias("mean_"))
    return labels.withColumn("mean_", total.scalar()).withColumn("weight", F.coalesce(F.try_divide(w, F.col("mean_")), F.lit(1.0))).drop("mean_")


def sequential_bootstrap(labels: DataFrame, draws: int | None = None, seed: int = 0, by: str = "symbol") -> DataFrame:
    """Draws (by, draw, t0) with chances in proportion to the uniqueness left after the draws before; by default as
    many as the group has labels.

    Each draw rests on those before it, so a group is one task; groups are the events of one name.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "t1"]).reset_index(drop=True)
        rng, lo = np.random.default_rng(seed), int(pdf["t0"].min())
        used = np.zeros(int(pdf["t1"].max()) - lo + 1)
        a, b = pdf["t0"].to_numpy() - lo, pdf["t1"].to_numpy() - lo + 1
        out = []
        for k in range(len(pdf) if draws is None else draws):
            inv = np.concatenate([[0.0], np.cumsum(1 / (used + 1))])
            u = (inv[b] - inv[a]) / (b - a)
            i = int(rng.choice(len(u), p=u / u.sum()))
            used[a[i] : b[i]] += 1
            out.append((pdf[by].iloc[0], k, int(pdf["t0"].iloc[i])))
        return pd.DataFrame(out, columns=[by, "draw", "t0"])

    return spread(labels, by).groupBy(by).applyInPandas(run, f"{by} {labels.schema[by].dataType.simpleString()}, draw int, t0 bigint")


class WeightedLogistic:
    """Logistic regression by gradient descent on standardised features: the weighted mean of the gradient beside the full
    l2 penalty."""

    def __init__(self, l2: float = 1.0, rate: float = 0.3, rounds: int = 800) -> None:
        self.l2, self.rate, self.rounds = l2, rate, rounds

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> WeightedLogistic:
        self.m, self.s = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        z, w = (x - self.m) / self.s, w / w.sum() if w.sum() > 0 else w / len(w)
        self.b, self.a = np.zeros(x.shape[1]), 0.0
        for _ in range(self.rounds):
            g = w * (1 / (1 + np.exp(-np.clip(z @ self.b + self.a, -30, 30))) - y)
            self.b = self.b - self.rate * (z.T @ g + self.l2 * self.b)
            self.a -= self.rate * g.sum()
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.m) / self.s @ self.b + self.a, -30, 30)))


def out_of_sample(events: DataFrame, roles: DataFrame, features: list[str]) -> DataFrame:
    """Mean predicted probability per event over the splits that test it; one model per split, side by side.

    events: (event, label, weight, features); roles: (split_id, event, role). Splits without both classes in
    training predict the class share.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["role"] == "train"].sort_values("event"), pdf[pdf["role"] == "test"]
        if not len(train) or not len(test):
            return pd.DataFrame({"event": pd.Series(dtype="int64"), "p": pd.Series(dtype="float64")})
        y = train["label"].to_numpy(float)
        p = np.full(len(test), y.mean())
        if 0 < y.mean() < 1:
            p = WeightedLogistic().fit(train[features].to_numpy(float), y, train["weight"].to_numpy(float)).predict(test[features].to_numpy(float))
        return pd.DataFrame({"event": test["event"].to_numpy(), "p": p})

    return spread(events.join(roles, "event"), "split_id").groupBy("split_id").applyInPandas(run, "event bigint, p double").groupBy("event").agg(F.avg("p").alias("p"))


def importance(events: DataFrame, roles: DataFrame, features: list[str], repeats: int = 3, seed: int = 0) -> DataFrame:
    """Loss of accuracy when a feature of the test rows is permuted, mean over splits and repeats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["role"] == "train"].sort_values("event"), pdf[pdf["role"] == "test"].sort_values("event")
        rng, out = np.random.default_rng(seed + int(pdf["split_id"].iloc[0])), []
        y = train["label"].to_numpy(float)
        if len(test) and len(y) and 0 < y.mean() < 1:
            m, x, t = WeightedLogistic().fit(train[features].to_numpy(float), y, train["weight"].to_numpy(float)), test[features].to_numpy(float), test["label"].to_numpy() > 0.5
            base = ((m.predict(x) > 0.5) == t).mean()
            for k, f in enumerate(features):
                for _ in range(repeats):
                    z = x.copy()
                    z[:, k] = rng.permutation(z[:, k])
                    out.append((f, float(base - ((m.predict(z) > 0.5) == t).mean())))
        return pd.DataFrame(out, columns=["feature", "loss"]).astype({"feature": "object", "loss": "float64"})

    return spread(events.join(roles, "event"), "split_id").groupBy("split_id").applyInPandas(run, "feature string, loss double").groupBy("feature").agg(F.avg("loss").alias("importance"))


def meta_dataset(labels: DataFrame, scores: DataFrame, regimes: DataFrame, by: str = "symbol") -> DataFrame:
    """Labels with the features known at their start: scores on the row itself, the regime carried forward (-1 before)."""
    reg = regimes.select("idx", "state")
    w = Window.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    days = scores.select("idx").distinct().join(reg, "idx", "left").withColumn("regime", F.coalesce(F.last("state", ignorenulls=True).over(w), F.lit(-1))).select(F.col("idx").alias("t0"), "regime")
    f = scores.withColumnRenamed("idx", "t0")
    return labels.join(f, [by, "t0"]).join(days, "t0").withColumn("dow", F.weekday("date")).withColumn("abs_s", F.abs("s"))


def bet_size(p: Column, mode: str, floor: float) -> Column:
    """off: 1; gate: 1 from the floor on; size: what p exceeds the floor by, as a share."""
    if mode == "off":
        return F.lit(1.0)
    if mode == "gate":
        return F.when(p >= floor, 1.0).otherwise(0.0)
    return F.least(F.greatest((p - floor) / (1 - floor), F.lit(0.0)), F.lit(1.0))


def carry_size(positions: DataFrame, sized: DataFrame, by: str = "symbol", order: str = "idx") -> DataFrame:
    """An entry's size over the run it opens, until the position changes; runs without a size have 1."""
    w = Window.partitionBy(by).orderBy(order)
    p = positions.withColumn("new_", (F.col("pos") != F.lag("pos", 1, 0).over(w)).cast("int"))
    p = p.withColumn("run", F.sum("new_").over(rows(by, order))).drop("new_")
    met = p.join(sized.select(by, F.col("t0").alias(order), "size"), [by, order], "left")
    first = F.first("size").over(Window.partitionBy(by, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("size", F.coalesce(first, F.lit(1.0))).drop("run")


def sized_weights(positions: DataFrame, gross: float = 1.0, by: str = "date") -> DataFrame:
    """Each side holds half the gross, in proportion to size; one side alone stays flat."""
    w = Window.partitionBy(by)
    side = lambda s: F.sum(F.when(F.col("pos") == s, F.col("size")).otherwise(0.0)).over(w)
    both = (side(1) > 0) & (side(-1) > 0)
    return positions.withColumn("weight", F.when(both & (F.col("pos") == 1), gross / 2 * F.col("size") / F.nullif(side(1), F.lit(0.0))).when(both & (F.col("pos") == -1), -gross / 2 * F.col("size") / F.nullif(side(-1), F.lit(0.0))).otherwise(0.0))


def family(floors: list[float]) -> list[tuple[str, float]]:
    """Configurations of the meta search: off, then gate and size at each floor."""
    return [("off", 0.0), *[(m, f) for m in ("gate", "size") for f in floors]]


def family_weights(positions: DataFrame, scored: DataFrame, configs: list[tuple[str, float]]) -> DataFrame:
    """Books (config, date, symbol, idx, size, weight) of all configurations in one plan; scored: (symbol, t0, p)."""
    keyed = lambda df: df.withColumn("key", F.concat_ws("|", "config", "symbol"))
    sizes = F.array(*[F.struct(F.lit(i).alias("config"), bet_size(F.col("p"), m, f).alias("size")) for i, (m, f) in enumerate(configs)])
    sized = keyed(scored.select("symbol", "t0", F.explode(sizes).alias("c")).select("symbol", "t0", "c.*"))
    p = keyed(positions.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1)))))
    held = carry_size(p, sized, "key").withColumn("cell", F.concat_ws("|", "config", "date"))
    return sized_weights(held, by="cell").select("config", "date", "symbol", "idx", "size", "weight")


def engine_b(books: DataFrame, returns: DataFrame, configs: int, notionals: list[float], half_spread: float, grid: float, base: int, periods: int = 252) -> DataFrame:
    """(config, notional, net_pnl, net_sharpe): books of several sizes traded against a ladder of equal levels.

    books: (config, date, symbol, weight), held from the second row after; the shares that change hands the row before
    walk the ladder ``base`` a level. returns: (date, symbol, ret, close). Each walk is an arithmetic series of its row.
    """
    met = returns.select("date", "symbol", "ret", "close").withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(configs - 1)))).join(books.select("config", "date", "symbol", "weight"), ["config", "date", "symbol"], "left")
    w = Window.partitionBy("config", "symbol").orderBy("date")
    weight = F.coalesce("weight", F.lit(0.0))
    met = met.withColumn("next_", F.coalesce(F.lag(weight).over(w), F.lit(0.0))).withColumn("held_", F.coalesce(F.lag(weight, 2).over(w), F.lit(0.0)))
    met = met.withColumn("notional", F.explode(F.array(*[F.lit(x) for x in notionals])))
    q = F.floor(F.abs(F.col("next_") - F.col("held_")) * F.col("notional") / F.col("close"))
    k = F.floor(F.col("q") / base)
    cost = F.col("q") * half_spread + grid * (base * k * (k - 1) / 2 + (F.col("q") - base * k) * k)
    day = met.withColumn("q", q).withColumn("net", F.col("held_") * F.col("ret") * F.col("notional") - cost).groupBy("config", "notional", "date").agg(F.sum("net").alias("net"))
    return day.groupBy("config", "notional").agg(F.sum("net").alias("net_pnl"), (F.try_divide(F.avg("net"), F.stddev_samp("net")) * periods**0.5).alias("net_sharpe"))


def accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy at one half beside that of always naming the commoner class."""
    right = (F.col("p") > 0.5) == (F.col("label") == 1)
    share = F.avg(F.col("label").cast("double"))
    return scored.agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"), F.greatest(share, 1 - share).alias("baseline"))
