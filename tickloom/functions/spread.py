"""Laying out small but heavy groups, which adaptive execution would otherwise pack into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parallelism(df: DataFrame) -> int:
    """As many tasks as the session is set up for: partitions of a shuffle, and at least one per core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of the keys, or evenly without keys, over a stated number of partitions, which is not coalesced.

    Groups on the keys then need no further shuffle.
    """
    return df.repartition(parallelism(df), *keys)
