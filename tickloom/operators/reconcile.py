"""Differences between two copies of a dataset, by content-defined chunks of key-sorted rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import code, num
from tickloom.session import cut_lineage

MIX_1, MIX_2, BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x100000001B3


@dataclass(frozen=True)
class Field:
    """One compared field: its name in the report, the column on each side and how it is compared.

    kind: code (case and outer blanks ignored), number (differs beyond ``tolerance``; NaN is no
    value) or exact.
    """

    name: str
    left: str
    right: str
    kind: str = "exact"
    tolerance: float = 0.0

    def value(self, column: str) -> Column:
        return {"code": code, "number": lambda c: num(F.col(c).cast("double"))}.get(self.kind, F.col)(column)

    def token(self, c: Column) -> Column:
        """Equal tokens imply equal values; the reverse need not hold, the exact check decides it."""
        if self.kind == "number" and self.tolerance > 0:
            return F.rint(c / F.lit(self.tolerance))
        return c

    def differs(self, a: Column, b: Column) -> Column:
        if self.kind == "number" and self.tolerance > 0:
            return F.coalesce(F.abs(a - b) > F.lit(self.tolerance), a.isNull() != b.isNull())
        return ~a.eqNullSafe(b)


def latest_rows(df: DataFrame, key: str, version: str, values: list[tuple[str, Column]]) -> DataFrame:
    """The row with the latest ``version`` of every key, pre-aggregated before the shuffle.

    Keys that are NULL or blank identify nothing and are left out. A NULL version is the oldest; of
    equal versions the row with the largest values holds, so the result is defined under ties.
    """
    names = [n for n, _ in values]
    rows = df.select(code(key).alias("k"), F.struct(F.col(version).alias("v"), *[c.alias(n) for n, c in values]).alias("r"))
    held = rows.where("k IS NOT NULL").groupBy("k").agg(F.max("r").alias("r"))
    return held.select("k", *[F.col(f"r.{n}").alias(n) for n in names])


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def rolling_cuts(key_hash: np.ndarray, window: int, average: int) -> np.ndarray:
    """True where a chunk ends: the polynomial hash of the last ``window`` keys meets the condition."""
    with np.errstate(over="ignore"):
        h, total, power = _mix(key_hash, MIX_1), np.zeros(len(key_hash), np.uint64), np.uint64(1)
        for back in range(min(window, len(h))):
            total[back:] += h[: len(h) - back] * power
            power = power * np.uint64(BASE)
    return (_mix(total, MIX_2) % np.uint64(average)) == 0


def _chunker(window: int, average: int, largest: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by (copy, key) within a key range that both sides share
        pending: list[pa.RecordBatch] = []
        tail, side_of_tail = np.zeros(0, np.int64), -1

        def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(parts).combine_chunks()
            n = table.num_rows
            if not n:
                return None
            side = table["copy"].to_numpy()
            last = np.flatnonzero(ends[:n]) if n else np.zeros(0, int)
            starts = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
            sig = table["sig"].to_numpy()
            with np.errstate(over="ignore"):
                one = np.add.reduceat(_mix(sig, MIX_1), starts)
                two = np.add.reduceat(_mix(sig ^ np.int64(0x5DEECE66D), MIX_2), starts)
            rows = pa.StructArray.from_arrays([table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in keep], names=keep)
            offsets = pa.array(np.append(starts, n).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array(side[starts], pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(np.append(starts, n)).astype(np.int32)), pa.ListArray.from_arrays(offsets, rows)],
                names=["copy", "print_1", "print_2", "n", "rows"],
            )

        held, held_since = 0, 0
        flags: list[np.ndarray] = []
        for batch in batches:
            side = batch.column(batch.schema.get_field_index("copy")).to_numpy()
            kh = batch.column(batch.schema.get_field_index("key_hash")).to_numpy()
            cuts = np.zeros(len(kh), bool)
            edges = np.flatnonzero(np.diff(side)) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(kh)), strict=True):
                if lo == hi:
                    continue
                if side[lo] != side_of_tail:
                    if lo > 0:
                        cuts[lo - 1] = True
                    elif flags:
                        flags[-1][-1] = True
                    tail, side_of_tail = np.zeros(0, np.int64), side[lo]
                seen = np.concatenate([tail, kh[lo:hi]])
                cuts[lo:hi] |= rolling_cuts(seen, window, average)[len(tail):]
                tail = seen[-(window - 1):] if window > 1 else seen[:0]
            pending.append(batch)
            flags.append(cuts)
            held += len(kh)
            whole = np.concatenate(flags)
            done = np.flatnonzero(whole)
            # a chunk never grows past the largest size: cut at the multiples counted from its start
            if not len(done) and held < largest:
                continue
            last = int(done[-1]) + 1 if len(done) else 0
            forced = _force(whole, largest, held)
            last = max(last, int(np.flatnonzero(forced)[-1]) + 1 if forced.any() else 0)
            if not last:
                continue
            table = pa.Table.from_batches(pending)
            ends = forced[:last]
            if (out := emit(table.slice(0, last).to_batches())) is not None:
                yield out
            rest = table.slice(last)
            pending, flags, held = rest.to_batches(), [forced[last:]] if held > last else [], held - last
        if held:
            whole = np.concatenate(flags)
            whole[-1] = True
            ends = _force(whole, largest, held)
            if (out := emit(pending)) is not None:
                yield out

    return run


def _force(cuts: np.ndarray, largest: int, n: int) -> np.ndarray:
    out = cuts.copy()
    ends = np.append(np.flatnonzero(cuts), n - 1)
    start = 0
    for e in ends:
        if e - start + 1 > largest:
            out[np.arange(start + largest - 1, e, largest)] = True
        start = e + 1
    return out


def chunk_table(left: DataFrame, right: DataFrame, fields: list[Field], window: int = 4, average: int = 64, largest: int = 4096) -> DataFrame:
    """Chunks of both sides: (copy, print_1, print_2, n, rows), one row per content-defined chunk."""
    names = [f.name for f in fields]
    both = None
    for side, df in ((0, left), (1, right)):
        tokens = [F.coalesce(f.token(F.col(f.name)).cast("string"), F.lit("\u0000")) for f in fields]
        part = df.select(F.lit(side).alias("copy"), "k", F.xxhash64("k").alias("key_hash"), F.xxhash64("k", *tokens).alias("sig"), *names)
        both = part if both is None else both.unionByName(part)
    row = T.StructType([T.StructField("k", T.StringType()), *[T.StructField(n, both.schema[n].dataType) for n in names]])
    schema = T.StructType([T.StructField("copy", T.IntegerType()), T.StructField("print_1", T.LongType()), T.StructField("print_2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("rows", T.ArrayType(row))])
    return both.repartitionByRange("k").sortWithinPartitions("copy", "k").mapInArrow(_chunker(window, average, largest, ["k", *names]), schema)


def differences(left: DataFrame, right: DataFrame, key: str, version: str, fields: list[Field], left_name: str = "local", right_name: str = "venue", window: int = 4, average: int = 64) -> DataFrame:
    """Every key only one side has and every field in which the latest rows of a key disagree.

    Returns (key, difference) with ``missing_<side>`` or the field's name. Both copies are reduced to
    the latest row per key, laid out in shared key ranges, cut into chunks where a rolling hash of the
    keys meets a condition, and fingerprinted. Chunks whose fingerprint the other side also has are
    equal (128 bits and a row count must agree) and go no further; only rows of unmatched chunks are
    joined and compared field by field, exactly. Empty inputs give an empty report, extra columns are
    ignored, repeated rows count once, NULL against a value is a difference and NULL against NULL
    is none.
    """
    held_l = latest_rows(left, key, version, [(f.name, f.value(f.left)) for f in fields])
    held_r = latest_rows(right, key, version, [(f.name, f.value(f.right)) for f in fields])
    chunks = cut_lineage(chunk_table(held_l, held_r, fields, window, average))
    prints = ["print_1", "print_2", "n"]
    ours, theirs = chunks.where("copy = 0"), chunks.where("copy = 1")
    rest_l = ours.join(theirs.select(*prints), prints, "left_anti").select(F.inline("rows"))
    rest_r = theirs.join(ours.select(*prints), prints, "left_anti").select(F.inline("rows"))
    names = [f.name for f in fields]
    a = rest_l.select("k", F.struct(*names).alias("a"))
    b = rest_r.select("k", F.struct(*names).alias("b"))
    pair = a.join(b, "k", "full")
    found = [F.when(f.differs(F.col(f"a.{f.name}"), F.col(f"b.{f.name}")), F.lit(f.name)) for f in fields]
    report = (
        F.when(F.col("a").isNull(), F.array(F.lit(f"missing_{left_name}")))
        .when(F.col("b").isNull(), F.array(F.lit(f"missing_{right_name}")))
        .otherwise(F.array_compact(F.array(*found)))
    )
    return pair.select(F.col("k").alias(key), F.explode(report).alias("difference"))
