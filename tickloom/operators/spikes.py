"""Implausible readings per source: extreme-value cutoffs, stuck runs and impossible values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

FINENESS = 1000  # histogram bins per factor e over all hours: 0.1 % wide, which bounds the error of a median
COARSENESS = 20  # the same of the hourly histograms, from which seasons and tails are told
EDGE = 12  # usable readings of context per field on either side of a bucket; a run needs 6, a group 3 and its anchors


def _bin(x: Column, fineness: int) -> Column:
    return F.when(x == 0, F.lit(-(10**9))).otherwise(F.rint(F.log(F.abs(x)) * fineness)).cast("bigint")


def middle(size: np.ndarray, n: np.ndarray, t: np.ndarray) -> float:
    """Median of a histogram: bins in order of ``size`` with counts and sums; two middle bins are averaged."""
    order = np.argsort(size, kind="stable")
    upto, mean = np.cumsum(n[order]), (t / n)[order]
    at = lambda r: mean[np.searchsorted(upto, r, side="right")]  # noqa: E731  rank r from 0
    return float(at((upto[-1] - 1) // 2) + at(upto[-1] // 2)) / 2


def tail_cutoff(r: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, risk: float, tail: float) -> float:
    """Peaks over threshold: the residual exceeded with probability ``risk`` per reading.

    Bins of absolute residuals r with counts and sums of the residual and its square. Excesses over the 1 - ``tail``
    quantile follow a generalised Pareto law, fitted by its first two moments, which exist for shapes below one half.
    """
    order = np.argsort(r, kind="stable")
    r, n, s1, s2 = r[order], n[order], s1[order], s2[order]
    total = n.sum()
    over = np.cumsum(n) > total * (1 - tail)
    u = float(r[~over].max(initial=0.0))
    k = n[over].sum()
    m = max(float(s1[over].sum() / k) - u, 0.0)
    v = max(float(s2[over].sum() / k - (s1[over].sum() / k) ** 2), 0.0)
    shape = min(max(0.5 * (1 - m * m / v), -0.5), 0.49) if v > 0 else 0.0
    scale, ratio = m * (1 - shape), risk * total / k
    z = u - scale * np.log(ratio) if abs(shape) < 1e-6 else u + scale / shape * (ratio**-shape - 1)
    return max(u, float(z))


def flag_readings(readings: DataFrame, bucket: dict[str, int], moves: float | None = 10.0, times_volume: float | None = 25.0, longest_group: int = 3, shortest_run: int = 6, risk: float = 1e-3, tail: float = 0.05, per_second: int = 1, per_task: int = 500_000) -> DataFrame:
    """Flag impossible, stuck and implausible readings per source.

    readings: (table_name, symbol, row_id, s, level, amount): time (``per_second`` units a second), a price-like reading and a
    volume-like one (NULL where the table has none). Returns (table_name, row_id, field, reason) with field
    level or amount and reason impossible, spike or stuck.

    Per source the moves between neighbouring readings, less their seasonal (hour of the day) median, and the log
    volumes, likewise, get a tail cutoff at a fixed risk by peaks over threshold. A reading over the cutoff is
    a candidate. Without ``moves`` and ``times_volume`` the cutoffs decide: a group of at most ``longest_group``
    readings that departs from the sound readings around it by more than the cutoff (beyond the season's move) is a
    spike, as is a volume over its cutoff. With them, cases are fixed multiples of the usual move and of the median
    volume: the cutoff then never exceeds the multiple, so no case is lost, and candidates are checked exactly. A
    level that lasts is no spike in either mode. Runs of ``shortest_run``
    equal readings are stuck from the second on. Halts (amount 0 and level unchanged) are no stuck readings.
    NULL readings, and rows without symbol, id or time, are left out; redelivered rows count once; equal
    times are ordered by id. Usual move and median are exact to 0.1 %.

    A hot source is split into time buckets (of ``bucket`` units by table, divided further where one would hold more
    than ``per_task`` readings); each gets the last and first usable readings of the buckets around it as context, level
    and amount apart, through a table of one row per bucket: readings that are NULL or impossible take no place in it.
    """
    key = ["table_name", "symbol", "b"]
    base = readings.where("symbol IS NOT NULL AND row_id IS NOT NULL AND s IS NOT NULL AND (level IS NOT NULL OR amount IS NOT NULL)")
    of = lambda width: F.floor(F.col("s") / F.create_map(*[x for t, b in width.items() for x in (F.lit(t), F.lit(b))])[F.col("table_name")])
    # the busiest bucket of each table decides how far its buckets are divided: a count, made before the shuffle
    busiest = base.groupBy("table_name", "symbol", of(bucket).alias("b")).count().groupBy("table_name").agg(F.max("count").alias("n")).collect()
    width = bucket | {r["table_name"]: max(bucket[r["table_name"]] // -(-r["n"] // per_task), 1) for r in busiest}
    base = base.select("table_name", "symbol", of(width).alias("b"), "s", "row_id", "level", F.col("amount").cast("double").alias("amount"))
    per_hour = 3600 * per_second
    summary = cut_lineage(base.groupBy(*key).applyInArrow(_summariser(per_hour), SUMMARY))
    context = _around(summary)
    limits = _limits(summary, context, risk, tail, per_hour)
    told = context.drop("level_heads").join(limits, ["table_name", "symbol"], "left")
    told = told.select(*[F.col(c).alias(f"of_{c}") for c in key], *SIDES, "usual", "typical", "move_season", "move_z", "log_season", "log_z")
    check = _checker(moves, times_volume, longest_group, shortest_run, per_hour)
    return base.groupBy(*key).cogroup(told.groupBy(*[f"of_{c}" for c in key])).applyInArrow(check, "table_name string, row_id bigint, field string, reason string")


READING = "struct<s:bigint,row_id:bigint,level:double,amount:double,live:boolean>"
ENDS = ("level_heads", "level_tails", "calm_heads", "calm_tails", "amount_heads", "amount_tails")  # all levels, those that are no halts, amounts
SIDES = ("level_before", "level_after", "calm_before", "calm_after", "amount_before", "amount_after")
SUMMARY = f"table_name string, symbol string, b bigint, {', '.join(f'{c} array<{READING}>' for c in ENDS)}, bins array<struct<what:string,hour:int,sign:int,bin:bigint,n:bigint,t:double,tt:double>>"


def _around(summary: DataFrame) -> DataFrame:
    """Each bucket with the last usable readings before it and the first ones after it, per field.

    However many buckets in between hold none, the nearest ones that do are found: their readings are gathered
    among buckets that have some, and then carried over those that have not.
    """
    source = ["table_name", "symbol"]
    earlier = Window.partitionBy(*source).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # whether a bucket's first level halts, the level before it tells
    out = summary.withColumn("held", F.last(F.try_element_at("level_tails", F.lit(-1))["level"], ignorenulls=True).over(earlier))
    told = lambda r: F.coalesce(r["live"], F.coalesce(r["level"] != F.col("held"), F.lit(True)))
    full = lambda r: F.struct(*[r[c].alias(c) for c in ("s", "row_id", "level", "amount")], told(r).alias("live"))
    out = out.withColumns({c: F.transform(c, full) for c in ENDS}).withColumns({c: F.filter(c, lambda r: r["live"]) for c in ENDS[2:]}).drop("held")
    for k, side in enumerate(SIDES):
        back = k % 2 == 0
        ends = ENDS[k + 1] if back else ENDS[k - 1]
        order, has = F.col("b") if back else -F.col("b"), F.size(ends) > 0
        lists = F.collect_list(ends).over(Window.partitionBy(*source, has).orderBy(order).rowsBetween(-EDGE, 0))
        x = F.flatten(lists if back else F.reverse(lists))
        n = F.least(F.size("x_"), F.lit(EDGE + 1))
        cut = F.when(n > 0, F.slice("x_", F.size("x_") - n + 1 if back else F.lit(1), n))
        out = out.withColumn("x_", F.when(has, x)).withColumn("x_", cut)
        out = out.withColumn(side, F.last("x_", ignorenulls=True).over(Window.partitionBy(*source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    return out.select(*source, "b", "level_heads", *SIDES)


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's readings in order of time, redelivered ones once: s, row_id, level, level is NULL, amount."""
    s, ids = table["s"].to_numpy(), table["row_id"].to_numpy()
    null = table["level"].is_null().to_numpy()
    level, amount = table["level"].to_numpy().astype(float), table["amount"].to_numpy().astype(float)
    order = np.lexsort((ids, s))
    s, ids = s[order], ids[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (ids[1:] != ids[:-1])]) if len(s) else np.zeros(0, bool)
    order = order[first]
    return s[first], ids[first], level[order], null[order], amount[order]


def _possible(level: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.isfinite(level) & (level > 0)


def _binned(what: str, x: np.ndarray, hour: np.ndarray | None = None) -> list[dict]:
    """A measure's histogram, coarse by hour or fine over all (hour -1); sums are exact, so that a bin's mean is."""
    if not len(x):
        return []
    sign = np.sign(x).astype(np.int64)
    with np.errstate(divide="ignore"):
        bins = np.where(x == 0, -(10**9), np.rint(np.log(np.abs(x)) * (FINENESS if hour is None else COARSENESS))).astype(np.int64)
    hour = np.full(len(x), -1) if hour is None else hour
    cells, at = np.unique(np.stack([hour, sign, bins]), axis=1, return_inverse=True)
    n, t, tt = (np.bincount(at, w, cells.shape[1]) for w in (np.ones(len(x)), x, x * x))
    return [{"what": what, "hour": int(h), "sign": int(g), "bin": int(k), "n": int(n[i]), "t": float(t[i]), "tt": float(tt[i])} for i, (h, g, k) in enumerate(cells.T)]


def _summariser(per_hour: int) -> Callable[[pa.Table], pa.Table]:
    """First pass over a bucket: its first and last readings, and histograms of moves and amounts."""

    def run(table: pa.Table) -> pa.Table:
        s, ids, level, null, amount = _in_order(table)
        seq = np.flatnonzero(_possible(level))
        live = np.ones(len(s), bool)  # no halt; the bucket's first level cannot tell
        live[seq[1:]] = ~((amount[seq[1:]] == 0) & (np.diff(level[seq]) == 0))
        unknown = seq[:1][amount[seq[:1]] == 0]
        flow = np.flatnonzero(~np.isnan(amount) & live)
        rows = lambda idx: [{"s": int(s[i]), "row_id": int(ids[i]), "level": None if null[i] else float(level[i]), "amount": None if np.isnan(amount[i]) else float(amount[i]), "live": None if i in unknown else bool(live[i])} for i in idx]
        calm = seq[live[seq]]
        n = EDGE + 1
        ends = [rows(x) for i in (seq, calm, flow) for x in (i[:n], i[-n:])]
        hour = (s // per_hour) % 24
        good = np.flatnonzero(_possible(level))
        has = np.flatnonzero(~np.isnan(amount))
        up = has[amount[has] >= 0]
        moves = np.diff(level[good])
        bins = _binned("move", np.abs(moves)) + _binned("move", moves, hour[good[1:]]) + _binned("size", amount[has]) + _binned("log", np.log1p(amount[up]), hour[up])
        k = table.slice(0, 1)
        schema = pa.schema([("table_name", pa.string()), ("symbol", pa.string()), ("b", pa.int64()), *[(c, pa.list_(ROW)) for c in ENDS], ("bins", pa.list_(BIN))])
        return pa.Table.from_arrays([*[k[c].combine_chunks() for c in ("table_name", "symbol", "b")], *[pa.array([e], schema.field(c).type) for c, e in zip(ENDS, ends)], pa.array([bins], schema.field("bins").type)], schema=schema)

    return run


ROW = pa.struct([("s", pa.int64()), ("row_id", pa.int64()), ("level", pa.float64()), ("amount", pa.float64()), ("live", pa.bool_())])
BIN = pa.struct([("what", pa.string()), ("hour", pa.int32()), ("sign", pa.int32()), ("bin", pa.int64()), ("n", pa.int64()), ("t", pa.float64()), ("tt", pa.float64())])


def _limits(summary: DataFrame, context: DataFrame, risk: float, tail: float, per_hour: int) -> DataFrame:
    """One row per source: usual move, median volume, and hourly candidate cutoffs for both fields."""
    source = ["table_name", "symbol"]
    first, last = F.try_element_at("level_heads", F.lit(1)), F.try_element_at("level_before", F.lit(-1))
    # moves across the seams of buckets complete those within
    seam = context.where((F.size("level_heads") > 0) & (F.size("level_before") > 0))
    seam = seam.select(*source, (F.floor(first["s"] / per_hour) % 24).cast("int").alias("h"), (first["level"] - last["level"]).alias("d"))
    cell = lambda hour, x, fineness: F.struct(hour.cast("int").alias("hour"), F.signum(x).cast("int").alias("sign"), _bin(x, fineness).alias("bin"), x.alias("t"), (x * x).alias("tt"))
    seam = seam.select(*source, F.explode(F.array(cell(F.lit(-1), F.abs("d"), FINENESS), cell(F.col("h"), F.col("d"), COARSENESS))).alias("c"))
    seam = seam.select(*source, F.lit("move").alias("what"), "c.hour", "c.sign", "c.bin", F.lit(1).cast("bigint").alias("n"), "c.t", "c.tt")
    h = summary.select(*source, F.explode("bins").alias("c")).select(*source, "c.*").unionByName(seam)
    h = h.groupBy(*source, "what", "hour", "sign", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "t", "tt")])
    return h.groupBy(*source).applyInArrow(_source_limits(risk, tail), LIMITS)


LIMITS = "table_name string, symbol string, usual double, typical double, move_season array<double>, move_z array<double>, log_season array<double>, log_z array<double>"


def _source_limits(risk: float, tail: float) -> Callable[[pa.Table], pa.Table]:
    """A source's limits from its histogram, whose size is bounded by the number of bins."""
    numbers = pa.list_(pa.float64())
    schema = pa.schema([("table_name", pa.string()), ("symbol", pa.string()), ("usual", pa.float64()), ("typical", pa.float64()), *[(c, numbers) for c in ("move_season", "move_z", "log_season", "log_z")]])

    def run(h: pa.Table) -> pa.Table:
        what = np.array(h["what"].to_pylist(), object)
        hour, sign, bins, n, t, tt = (h[c].to_numpy() for c in ("hour", "sign", "bin", "n", "t", "tt"))
        place = sign * (bins + 10**6)  # signed order of the bins; zero has sign 0
        out: dict[str, object] = {}
        for name, which, order in (("usual", "move", bins), ("typical", "size", place)):
            i = np.flatnonzero((what == which) & (hour < 0))
            out[name] = middle(order[i], n[i], t[i]) if len(i) else None
        for which in ("move", "log"):
            season, z = np.zeros(24), np.full(24, np.inf)
            i = np.flatnonzero((what == which) & (hour >= 0))
            for x in np.unique(hour[i]):
                j = i[hour[i] == x]
                season[x] = middle(place[j], n[j], t[j])
            if len(i):
                s = season[hour[i]]
                r = t[i] / n[i] - s
                s2 = np.maximum(tt[i] - 2 * s * t[i] + n[i] * s * s, 0.0)
                up = np.ones(len(i), bool) if which == "move" else r > 0  # only high volumes are of interest
                if up.any():
                    z[:] = tail_cutoff(np.abs(r[up]), n[i][up], (np.abs(r) * n[i])[up], s2[up], risk, tail)
            out[f"{which}_season"], out[f"{which}_z"] = season.tolist(), z.tolist()
        first = h.slice(0, 1).select(["table_name", "symbol"])
        return pa.Table.from_arrays([first["table_name"].combine_chunks(), first["symbol"].combine_chunks(), *[pa.array([out[f.name]], f.type) for f in list(schema)[2:]]], schema=schema)

    return run


def _spikes(x: np.ndarray, candidate: np.ndarray, limit: np.ndarray, longest: int) -> np.ndarray:
    """Exact check around the candidate breaks (positions whose move from the reading before is unusual); limits by position."""
    bad, n, nxt = np.zeros(len(x), bool), len(x), 0

    def group(at: int, base: float) -> int:
        side = np.sign(x[at] - base)
        for k in range(1, min(longest, n - at - 1) + 1):
            own = x[at : at + k]
            if np.all((own - base) * side > limit[at : at + k]) and np.all((own - x[at + k]) * side > limit[at : at + k]):
                return k
        return 0

    for i in candidate:
        if i < nxt:
            continue
        at, base = i, x[i - 1]
        while at < n and abs(x[at] - base) > limit[at] and (k := group(at, base)):
            bad[at : at + k] = True
            at += k
        nxt = at + 1  # sound, or a level that lasts
    return bad


def _stuck(x: np.ndarray, shortest: int) -> np.ndarray:
    if len(x) < shortest:
        return np.zeros(len(x), bool)
    start = np.concatenate([[True], x[1:] != x[:-1]])
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, len(x)))
    return np.repeat(length >= shortest, length) & ~start


def _merged(s: np.ndarray, ids: np.ndarray, columns: list[np.ndarray], near: list[dict], names: list[str]) -> tuple[np.ndarray, ...]:
    """A bucket's readings with those around it in order of time: mine, s, ids and the columns."""
    seen, more = set(), []
    for r in near:
        if (r["s"], r["row_id"]) not in seen:
            seen.add((r["s"], r["row_id"]))
            more.append(r)
    mine = np.concatenate([np.ones(len(s), bool), np.zeros(len(more), bool)])
    s = np.concatenate([s, np.array([r["s"] for r in more], np.int64)])
    ids = np.concatenate([ids, np.array([r["row_id"] for r in more], np.int64)])
    columns = [np.concatenate([c, np.array([np.nan if r[n] is None else float(r[n]) for r in more], float)]) for c, n in zip(columns, names)]
    order = np.lexsort((ids, s))
    return mine[order], s[order], ids[order], *[c[order] for c in columns]


def _checker(moves: float | None, times_volume: float | None, longest: int, shortest: int, per_hour: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Second pass over a bucket, with its context and its source's limits."""
    schema = pa.schema([("table_name", pa.string()), ("row_id", pa.int64()), ("field", pa.string()), ("reason", pa.string())])

    def check(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        ctx = {c: told[c][0].as_py() if told.num_rows else None for c in (*SIDES, "usual", "typical", "move_season", "move_z", "log_season", "log_z")}
        near = lambda *of: [r for f in of for side in ("before", "after") for r in ctx[f"{f}_{side}"] or []]
        s, ids, level, null, amount = _in_order(own)
        out: list[tuple[np.ndarray, str, str]] = []

        def tell(flagged: np.ndarray, field: str, reason: str) -> None:
            if len(flagged):
                out.append((flagged, field, reason))

        # levels
        possible = _possible(level)
        tell(ids[~null & ~possible], "level", "impossible")
        at = np.flatnonzero(possible)
        mine, t, k, x, flow, live = _merged(s[at], ids[at], [level[at], amount[at], np.full(len(at), np.nan)], near("level", "calm"), ["level", "amount", "live"])
        before = np.concatenate([[np.nan], x[:-1]])
        halt = np.where(np.isnan(live), (flow == 0) & (x == before), live == 0)
        hour = (t // per_hour) % 24
        usual = ctx["usual"]
        if usual is not None and len(x) > 1:
            season, z = np.array(ctx["move_season"])[hour], np.array(ctx["move_z"])[hour]
            limit = z + np.abs(season) if moves is None else np.full(len(x), moves * usual)
            cut = z if moves is None else np.minimum(z, limit - np.abs(season))
            candidate = np.flatnonzero(np.abs((x - before) - season) > cut)
            bad = _spikes(x, candidate[candidate > 0], limit, longest)
            tell(k[bad & mine], "level", "spike")
        stuck = np.zeros(len(x), bool)
        stuck[~halt] = _stuck(x[~halt], shortest)
        tell(k[stuck & mine], "level", "stuck")
        # amounts; what halts is told by the levels
        still = set(zip(t[halt].tolist(), k[halt].tolist()))
        has = np.flatnonzero(~np.isnan(amount))
        if len(has):
            tell(ids[has[amount[has] < 0]], "amount", "impossible")
            typical = ctx["typical"]
            if typical is not None:
                hour = (s[has] // per_hour) % 24
                season, z = np.array(ctx["log_season"])[hour], np.array(ctx["log_z"])[hour]
                over = np.log1p(np.maximum(amount[has], 0.0)) - season
                if times_volume is None:
                    bad = over > z
                else:
                    bound = np.log1p(max(times_volume * typical, 0.0))
                    bad = (over >= np.minimum(z, bound - season) - 1e-12) & (amount[has] > times_volume * typical)
                tell(ids[has[bad]], "amount", "spike")
            mine, t, k, x = _merged(s[has], ids[has], [amount[has]], near("amount"), ["amount"])
            live = np.array([(a, b) not in still for a, b in zip(t.tolist(), k.tolist())], bool) if still else np.ones(len(x), bool)
            stuck = np.zeros(len(x), bool)
            stuck[live] = _stuck(x[live], shortest)
            tell(k[stuck & mine], "amount", "stuck")
        if not out:
            return schema.empty_table()
        name = own["table_name"][0].as_py()
        n = [len(i) for i, _, _ in out]
        return pa.Table.from_arrays([pa.array([name] * sum(n), pa.string()), pa.array(np.concatenate([i for i, _, _ in out])), pa.array([f for (_, f, _), k in zip(out, n) for _ in range(k)], pa.string()), pa.array([r for (_, _, r), k in zip(out, n) for _ in range(k)], pa.string())], schema=schema)

    return check
