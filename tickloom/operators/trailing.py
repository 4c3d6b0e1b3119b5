"""Rolling totals over trailing calendar periods, from cumulative prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = "decimal(38,12)"


def trailing_totals(df: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30), carry: tuple[str, ...] = ()) -> DataFrame:
    """Totals, counts and averages of ``value`` over the trailing periods, for every entity and day.

    One row per entity and calendar day between its first and last row, days without rows included.
    Values are added up per day first (map-side), then as exact decimal prefix sums per entity; a
    day without rows keeps the prefix of the day before it, and a trailing total is the difference
    of the prefixes at the two ends of its period. The window holds one row per day, so a hot
    entity costs no more than its calendar.
    NULL and NaN values do not count; a period without values has total 0 and average NULL; rows without
    entity or day are left out. Values are summed to 12 decimals; infinite ones and those of 1e18 and more
    count as no value. ``carry`` columns are the largest of the day's rows and NULL on other days.
    """
    x = F.when(~F.isnan(value) & (F.abs(value) < 1e18), F.col(value).cast("decimal(32,12)"))
    daily = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).cast("date").alias("day"))
        .agg(F.sum(x).cast(EXACT).alias("s"), F.count(x).alias("c"), F.max(F.struct(F.lit(1).alias("real"), *[F.col(c) for c in carry])).alias("kept"))
    )
    w = Window.partitionBy("entity").orderBy("day")
    prefix = daily.select(
        "entity", "day", "kept", F.lead("day").over(w).alias("next"),
        F.sum(F.coalesce("s", F.lit(0).cast(EXACT))).over(w).cast(EXACT).alias("ps"), F.sum("c").over(w).alias("pc"),
    )
    upto = F.coalesce(F.date_sub("next", 1), F.col("day"))
    dense = prefix.select("entity", F.col("day").alias("first"), F.explode(F.sequence("day", upto)).alias("day"), "kept", "ps", "pc")
    out = [F.col("entity").alias(entity), F.col("day").alias(day)]
    out += [F.when(F.col("day") == F.col("first"), F.col(f"kept.{c}")).alias(c) for c in carry]
    out.append((F.col("day") == F.col("first")).alias("has_rows"))
    for p in periods:
        total = F.col("ps") - F.coalesce(F.lag("ps", p).over(w), F.lit(0).cast(EXACT))
        n = F.col("pc") - F.coalesce(F.lag("pc", p).over(w), F.lit(0))
        out += [total.cast("double").alias(f"total_{p}"), n.alias(f"n_{p}"), F.when(n > 0, total.cast("double") / n).alias(f"mean_{p}")]
    return dense.select(*out)
