"""Attributes as known at event time: a bitemporal as-of join without leakage from the future."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def as_known(events: DataFrame, changes: DataFrame, kinds: list[str], bucket_us: int = 7 * DAY, per_task: int = 200_000) -> DataFrame:
    """For every event and kind, the version in force that was known at the event's instant.

    events: (entity, event_id, at); changes: (entity, kind, change_id, valid, known), all instants
    in microseconds, ``valid`` the start of a day. A version counts from max(valid, known) on; of those that count
    the one with the latest ``valid``, then latest ``known``, then largest id holds. Returns (event_id, kind,
    change_id), no row where nothing was known. Rows lacking an entity, id or instant are left out;
    repeated events and changes count once.

    Both sides are co-grouped by entity and time bucket, so that neither a hot entity nor a long history
    meets in one task: each bucket gets, beside its own changes, the single best version per kind of all
    earlier buckets (a running maximum over one row per bucket). Buckets of ``bucket_us`` are divided in time where the
    fullest one would hold more than ``per_task`` events. Inside a group
    the versions in order of activation are turned into a running best, found by vectorised binary search.
    """
    ev = events.select("entity", "event_id", "at").dropna()
    fullest = ev.groupBy("entity", F.floor(F.col("at") / bucket_us)).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
    parts = F.greatest(F.ceil(fullest.scalar() / per_task), F.lit(1))
    width = F.greatest(F.floor(F.lit(bucket_us) / parts), F.lit(1)).cast("bigint")
    ev = ev.withColumn("b", F.floor(F.col("at") / width))
    ch = changes.where(F.col("kind").isin(kinds)).select("entity", "kind", "change_id", "valid", "known").dropna()
    ch = ch.withColumn("active", F.greatest("valid", "known")).withColumn("b", F.floor(F.col("active") / width))
    best = ch.groupBy("entity", "kind", "b").agg(F.max(F.struct("valid", "known", "change_id")).alias("best"))
    # event buckets hold no change of their own unless some became active in them
    asked = ev.select("entity", "b").distinct().select("entity", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), "b", F.lit(None).cast(best.schema["best"].dataType).alias("best"), F.lit(1).alias("ask"))
    w = Window.partitionBy("entity", "kind").orderBy("b").rangeBetween(Window.unboundedPreceding, -1)
    carried = best.withColumn("ask", F.lit(0)).unionByName(asked).withColumn("carry", F.max("best").over(w)).where("ask = 1 AND carry IS NOT NULL")
    carried = carried.select("entity", "kind", *[F.col(f"carry.{c}").alias(c) for c in ("change_id", "valid", "known")], F.greatest("carry.valid", "carry.known").alias("active"), "b")
    keys = ["entity", "b"]
    versions = ch.unionByName(carried).select(*[F.col(k).alias(f"of_{k}") for k in keys], "kind", "change_id", "valid", "known", "active")
    return ev.groupBy(*keys).cogroup(versions.groupBy(*[f"of_{k}" for k in keys])).applyInArrow(_search, "event_id bigint, kind string, change_id bigint")


FOUND = pa.schema([("event_id", pa.int64()), ("kind", pa.string()), ("change_id", pa.int64())])


def _search(ev: pa.Table, ch: pa.Table) -> pa.Table:
    if not ev.num_rows or not ch.num_rows:
        return FOUND.empty_table()
    ids, first = np.unique(ev["event_id"].to_numpy(), return_index=True)
    at = ev["at"].to_numpy()[first]
    change, valid, known, active = (ch[c].to_numpy() for c in ("change_id", "valid", "known", "active"))
    kinds = np.array(ch["kind"].to_pylist(), object)
    out = []
    for kind in sorted(set(kinds)):
        own = np.flatnonzero(kinds == kind)
        own = own[np.lexsort((change[own], known[own], valid[own]))]  # from the weakest to the best
        by = np.argsort(active[own], kind="stable")
        best = np.maximum.accumulate(by)  # rank of the best version active so far
        where = np.searchsorted(active[own][by], at, side="right") - 1
        hit = where >= 0
        out.append(pa.table([pa.array(ids[hit]), pa.array([kind] * int(hit.sum()), pa.string()), pa.array(change[own[best[where[hit]]]])], schema=FOUND))
    return pa.concat_tables(out)
