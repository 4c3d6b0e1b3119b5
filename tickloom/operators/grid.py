"""Irregular readings onto a regular time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import code, micros, num


def epoch_seconds(raw: Column, instant: Column) -> Column:
    """Whole seconds of a feed's own clock: milliseconds are recognised by size, NULL falls back on ``instant``."""
    own = F.when(F.abs(raw) >= F.lit(100_000_000_000), F.floor(raw / F.lit(1000))).otherwise(raw)
    return F.coalesce(own.cast("bigint"), F.floor(micros(instant) / F.lit(1_000_000)).cast("bigint"))


def regular_series(readings: DataFrame, source: str, row_id: str, second: Column, price: str, volume: str, order: Column, step: int = 300, max_gap: int = 3, cycle: int = 86_400) -> DataFrame:
    """One row per source and slot of ``step`` seconds, between the first and last used slot of each cycle.

    Columns: source, slot_start_s, n, open, close, mean_price, volume, state, filled_price. ``state`` is
    observed, filled (the last observation, at most ``max_gap`` slots old) or missing. A reading is usable if
    its source, price and time are known (NaN is unknown). Redelivered readings (same row id) count once.
    Readings are pre-aggregated per slot before anything is ordered, so a hot source is bounded by
    its slots; the series is generated per source and cycle (one UTC day), never across the whole span.
    """
    rows = readings.select(code(source).alias("source"), F.col(row_id).alias("id"), second.alias("s"), order.alias("o"), num(price).alias("p"), F.col(volume).alias("v"))
    rows = rows.where("source IS NOT NULL AND p IS NOT NULL AND s IS NOT NULL").withColumn("slot", F.col("s") - F.pmod(F.col("s"), F.lit(step)))
    once = rows.groupBy("source", "slot", "id").agg(F.min(F.struct("o", "p", "v")).alias("r"))
    at = F.struct("r.o", "id")
    slots = once.groupBy("source", "slot").agg(
        F.count("*").alias("n"), F.min_by("r.p", at).alias("open"), F.max_by("r.p", at).alias("close"), F.avg("r.p").alias("mean_price"), F.sum("r.v").alias("volume")
    )
    day = F.floor(F.col("slot") / cycle)
    w = Window.partitionBy("source", "day").orderBy("slot")
    used = slots.withColumn("day", day).withColumn("next", F.lead("slot").over(w))
    # the gap after each used slot is generated from it: no join, and the observation to carry is at hand
    series = used.select("*", F.explode(F.sequence(F.col("slot"), F.coalesce(F.col("next") - step, F.col("slot")), F.lit(step).cast("bigint"))).alias("at"))
    seen = F.col("at") == F.col("slot")
    age = (F.col("at") - F.col("slot")) / step
    return series.select(
        F.col("source").alias(source), F.col("at").alias("slot_start_s"), F.when(seen, F.col("n")).otherwise(F.lit(0)).alias("n"),
        *[F.when(seen, F.col(c)).alias(c) for c in ("open", "close", "mean_price")],
        F.when(seen, F.col("volume")).otherwise(F.lit(0)).alias("volume"),
        F.when(seen, "observed").when(age <= max_gap, "filled").otherwise("missing").alias("state"),
        F.when(age <= max_gap, F.col("close")).alias("filled_price"),
    )
