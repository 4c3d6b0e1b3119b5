"""Pairing each record with the nearest record in time of the same entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int, bucket_us: int = 900_000_000, per_task: int = 500_000) -> DataFrame:
    """For each left record the nearest right one of its entity, before or after, within the tolerance.

    left: (entity, left_id, at); right: (entity, right_id, at), instants in microseconds. Returns (left_id, right_id,
    gap_us), no row where nothing is near enough. Both tables are united, sorted per entity and time, and the
    last and the next right-side record are carried onto the left rows; of two equally near ones the earlier
    counts, of several at one instant the one with the smallest id. Rows lacking an entity, id or instant
    are left out; repeated rows count once; empty sides give no rows.

    Time is cut into buckets, so that a hot entity spreads over many tasks; right rows within the tolerance of
    an edge also go to the bucket beyond it. Buckets of ``bucket_us`` are divided where the fullest one would hold more
    than ``per_task`` records, though not below four tolerances, since rows near edges are held twice.
    """
    least = max(4 * tolerance_us, 1)
    bucket_us = max(bucket_us, least)
    a = left.select("entity", F.col("left_id"), "at").dropna()
    r = right.select("entity", F.col("right_id"), "at").dropna()
    wide = lambda df: df.select("entity", F.floor(F.col("at") / F.lit(bucket_us)).alias("b"))
    fullest = wide(a).unionByName(wide(r)).groupBy("entity", "b").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
    width = F.greatest(F.floor(F.lit(bucket_us) / F.greatest(F.ceil(fullest.scalar() / per_task), F.lit(1))), F.lit(least)).cast("bigint")
    a, r = a.withColumn("width", width), r.withColumn("width", width)
    bucket = lambda c: F.floor(c / F.col("width")).cast("bigint")
    a = a.select("entity", bucket(F.col("at")).alias("b"), "at", F.lit(1).alias("is_left"), F.col("left_id").alias("id"))
    first, last = bucket(F.col("at") - tolerance_us), bucket(F.col("at") + tolerance_us)
    b = r.select("entity", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))).alias("b"), "at", F.lit(0).alias("is_left"), F.col("right_id").alias("id"))
    both = a.unionByName(b)
    here = Window.partitionBy("entity", "b")
    seen = F.when(F.col("is_left") == 0, F.struct(F.col("at").alias("at"), F.col("id").alias("id")))
    # two opposite sorts of one shuffle: frames that grow only forward are linear, the mirrored one is not
    up = here.orderBy("at", "is_left", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    down = here.orderBy(F.desc("at"), "is_left", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("before", F.last(seen, ignorenulls=True).over(up)).withColumn("after", F.last(seen, ignorenulls=True).over(down)).where("is_left = 1")
    gap_b, gap_a = F.col("at") - F.col("before.at"), F.col("after.at") - F.col("at")
    use_before = F.coalesce(gap_b <= gap_a, F.col("before").isNotNull())
    picked = near.select(F.col("id").alias("left_id"), F.when(use_before, F.struct(gap_b.alias("gap_us"), F.col("before.id").alias("right_id"))).otherwise(F.struct(gap_a.alias("gap_us"), F.col("after.id").alias("right_id"))).alias("p"))
    picked = picked.where(F.col("p.gap_us") <= tolerance_us)
    return picked.groupBy("left_id").agg(F.min("p").alias("p")).select("left_id", "p.right_id", "p.gap_us")
