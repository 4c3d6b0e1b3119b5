"""Running values of a series that is too long for one task: windows per bucket, and a carry between buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], order: list[str], bucket: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums, maxima and last known (non-NULL) values per series, each row's own included, and values of the row before.

    A series is cut into buckets that follow its order (a day, or a range of sequence numbers). Rows are
    shuffled by series and bucket, so a hot series spreads over its buckets; what comes into a bucket is a running
    value over one pre-aggregated row per bucket. A sum without any value so far is 0, a maximum or last value NULL.
    """
    sums, lasts, before, maxima = sums or {}, lasts or {}, before or {}, maxima or {}
    d = df.withColumns({"b_": bucket, **{f"s_{n}": c for n, c in sums.items()}, **{f"l_{n}": c for n, c in lasts.items()}, **{f"m_{n}": c for n, c in maxima.items()}, **{f"p_{n}": F.struct(c.alias("v")) for n, c in before.items()}})
    at = F.struct(*order)
    totals = d.groupBy(*by, "b_").agg(F.lit(1).alias("one_"), *[F.max(f"m_{n}").alias(f"x_{n}") for n in maxima], *[F.sum(f"s_{n}").alias(f"t_{n}") for n in sums], *[F.max_by(f"l_{n}", F.when(F.col(f"l_{n}").isNotNull(), at)).alias(f"v_{n}") for n in lasts], *[F.max_by(f"p_{n}", at).alias(f"q_{n}") for n in before])
    line = Window.partitionBy(*by).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "b_", *[F.max(f"x_{n}").over(line).alias(f"x_{n}") for n in maxima], *[F.sum(f"t_{n}").over(line).alias(f"t_{n}") for n in sums], *[F.last(f"v_{n}", ignorenulls=True).over(line).alias(f"v_{n}") for n in lasts], *[F.last(f"q_{n}").over(line).alias(f"q_{n}") for n in before])
    here = Window.partitionBy(*by, "b_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(*by, "b_").orderBy(*order)
    own = d.withColumns({**{f"m_{n}": F.max(f"m_{n}").over(here) for n in maxima}, **{f"s_{n}": F.sum(f"s_{n}").over(here) for n in sums}, **{f"l_{n}": F.last(f"l_{n}", ignorenulls=True).over(here) for n in lasts}, **{f"p_{n}": F.lag(f"p_{n}").over(step) for n in before}})
    same = F.lit(True)
    for k in (*by, "b_"):
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}"))
    met = own.alias("o").join(carry.alias("c"), same, "left")
    out = {**{n: F.greatest(F.col(f"o.m_{n}"), F.col(f"c.x_{n}")) for n in maxima}, **{n: F.coalesce(F.col(f"o.s_{n}"), F.lit(0)) + F.coalesce(F.col(f"c.t_{n}"), F.lit(0)) for n in sums}, **{n: F.coalesce(F.col(f"o.l_{n}"), F.col(f"c.v_{n}")) for n in lasts}, **{n: F.coalesce(F.col(f"o.p_{n}"), F.col(f"c.q_{n}"))["v"] for n in before}}
    return met.select(*[F.col(f"o.{c}").alias(c) for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def overlapping(df: DataFrame, place: str, size: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows numbered 1, 2, ... by ``place``, cut into chunks that also hold ``back`` rows before and ``ahead`` rows after.

    Adds chunk_ and own_: a window over series and chunk then sees all it needs, and its own rows are kept after it.
    """
    first, last = F.greatest(F.floor((F.col(place) - 1 - ahead) / size), F.lit(0)), F.floor((F.col(place) - 1 + back) / size)
    out = df.withColumn("chunk_", F.explode(F.sequence(first, last)))
    return out.withColumn("own_", F.col("chunk_") == F.floor((F.col(place) - 1) / size))


def day_of(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000)


def rolling_sum(df: DataFrame, by: list[str], order: list[str], bucket: Column, value: str, n: int, name: str) -> DataFrame:
    """Sum of the last n rows' values, NULL where all of them are: the difference of two running sums.

    Rows are numbered by a running count and meet the row n places before them by an equi-join on the number, which
    spreads a hot series evenly. Exact for integers.
    """
    known = F.col(value).isNotNull().cast("int")
    r = running(df, by, order, bucket, sums={"n_": F.lit(1), "k_": known, "sum_": F.col(value)})
    then = r.select(*[F.col(k).alias(f"then_{k}") for k in by], (F.col("n_") + n).alias("n0_"), F.col("k_").alias("k0_"), F.col("sum_").alias("sum0_"))
    same = F.col("n_") == F.col("n0_")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"then_{k}"))
    met = r.join(then, same, "left")
    any_ = F.col("k_") > F.coalesce("k0_", F.lit(0))
    return met.withColumn(name, F.when(any_, F.col("sum_") - F.coalesce("sum0_", F.lit(0)))).select(*df.columns, name)
