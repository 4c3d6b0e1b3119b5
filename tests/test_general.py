"""The general data-processing operators against brute force, and their defined results in odd cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import drift, grid, knowntime, reconcile, spikes, trailing
from tickloom.plans.general import RECON_FIELDS

TS = dt.datetime(2024, 1, 1)
LOCAL = "order_id string, symbol string, side string, price double, quantity long, local_fill_qty long, status string, updated_at timestamp, k string, copy int"
VENUE = LOCAL.replace("local_fill_qty", "venue_fill_qty")


def order(oid, symbol="A", side="BUY", price=10.0, qty=5, fill=5, status="FILLED", minute=0):
    return (oid, symbol, side, price, qty, fill, status, TS + dt.timedelta(minutes=minute), "clash", 7)


def diffs(spark, left, right, **kw):
    a, b = spark.createDataFrame(left, LOCAL), spark.createDataFrame(right, VENUE)
    return sorted(tuple(r) for r in reconcile.differences(a, b, "order_id", "updated_at", RECON_FIELDS, **kw).collect())


def test_differences_by_field(spark):
    left = [order("a1 "), order("A2", price=float("nan")), order("a3", price=10.004), order("a4", price=10.006), order("a5", symbol=None), order("a6", fill=None), order("only"), order(None), order("  ")]
    right = [order("A1", symbol=" a"), order("a2", price=None), order("A3"), order("A4"), order("A5"), order("A6"), order("a7", side="sell")]
    assert diffs(spark, left, right) == [("A4", "price"), ("A5", "symbol"), ("A6", "fill_qty"), ("A7", "missing_local"), ("ONLY", "missing_venue")]


def test_differences_latest_row_and_repeats(spark):
    left = [order("x", status="PENDING", minute=0), order("X", minute=5), order("x", minute=5)]
    assert diffs(spark, left, [order("x", minute=9)]) == []
    assert diffs(spark, left, [order("x", status="PENDING", minute=9)]) == [("X", "status")]


def test_differences_empty(spark):
    assert diffs(spark, [], []) == []
    assert diffs(spark, [order("q")], []) == [("Q", "missing_venue")]


def test_differences_random(spark):
    rng = random.Random(3)
    left = [order(f"o{i:05d}", qty=rng.randint(1, 3)) for i in range(3000)]
    right, want = [], set()
    for r in left:
        u = rng.random()
        if u < 0.01:
            want.add((r[0].upper(), "missing_venue"))
        elif u < 0.02:
            right.append(order(r[0], qty=9))
            want.add((r[0].upper(), "quantity"))
        else:
            right.append(r)
    right += [order(f"p{i}") for i in range(5)]
    want |= {(f"P{i}", "missing_local") for i in range(5)}
    assert set(diffs(spark, left, right, average=16)) == want


def test_chunks_of_equal_stretches_match(spark):
    left = spark.createDataFrame([order(f"o{i:05d}") for i in range(4000)], LOCAL)
    right = spark.createDataFrame([order(f"o{i:05d}") for i in range(4000) if i != 2000], VENUE)
    lr = reconcile.latest_rows(left, "order_id", "updated_at", [(f.name, f.value(f.left)) for f in RECON_FIELDS])
    rr = reconcile.latest_rows(right, "order_id", "updated_at", [(f.name, f.value(f.right)) for f in RECON_FIELDS])
    chunks = reconcile.chunk_table(lr, rr, RECON_FIELDS)
    alone = chunks.groupBy("print_1", "print_2", "n").agg(F.count_distinct("copy").alias("c")).where("c = 1").count()
    assert 1 <= alone <= 12  # a missing row unsettles only the chunks around it
    assert chunks.agg(F.sum("n")).head()[0] == 7999


def test_trailing_against_brute_force(spark):
    rng = random.Random(1)
    day0 = dt.date(2024, 1, 1)
    rows = [("s" if rng.random() < 0.6 else "t", day0 + dt.timedelta(days=rng.randint(0, 120)), rng.choice([None, float("nan"), round(rng.random(), 6)]), 1) for _ in range(150)]
    rows += [(None, day0, 1.0, 1), ("u", None, 1.0, 1), ("v", day0, None, 1)]
    df = spark.createDataFrame(rows, "entity string, day date, x double, prefix int")
    got = {(r["entity"], r["day"]): r for r in trailing.trailing_totals(df, "entity", "day", "x").collect()}
    for e in ("s", "t", "v"):
        own = [(d, v) for s, d, v, _ in rows if s == e]
        lo, hi = min(d for d, _ in own), max(d for d, _ in own)
        assert sum(k[0] == e for k in got) == (hi - lo).days + 1
        d = lo
        while d <= hi:
            for p in (7, 30):
                vals = [v for x, v in own if v is not None and not math.isnan(v) and 0 <= (d - x).days < p]
                r = got[e, d]
                assert r[f"n_{p}"] == len(vals) and r[f"total_{p}"] == pytest.approx(sum(vals), abs=1e-9)
                assert r[f"mean_{p}"] == (pytest.approx(sum(vals) / len(vals)) if vals else None)
            d += dt.timedelta(days=1)


def test_trailing_empty(spark):
    assert trailing.trailing_totals(spark.createDataFrame([], "e string, d date, x double"), "e", "d", "x").count() == 0


def readings(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], "table_name string, symbol string, row_id long, s long, level double, amount long")


def flags(spark, rows, width=10**9, **kw):
    return {(r["row_id"], r["field"], r["reason"]) for r in spikes.flag_readings(readings(spark, rows), {"t": width}, **kw).collect()}


def walk(n, seed=0, start=100.0):
    rng = np.random.default_rng(seed)
    return [float(v) for v in np.round(start + np.cumsum(rng.choice([-0.1, 0.1, 0.2, -0.2], n)), 2)]


def test_spikes_stuck_and_levels(spark):
    x = walk(400)
    for i, v in ((50, 500.0), (51, 510.0), (80, 1.0), (81, 900.0)):
        x[i] = v
    x[120] = -1.0
    x[121] = float("nan")
    x[200:209] = [x[200]] * 9
    x = x[:300] + [v + 50 for v in x[300:]]  # a level that lasts
    rows = [("a", i, i * 60, v, 100 + i % 7) for i, v in enumerate(x)]
    rows[250] = ("a", 250, 250 * 60, x[250], 10_000)
    rows[251] = ("a", 251, 251 * 60, x[251], -5)
    rows[252] = ("a", 252, 252 * 60, None, None)
    want = {(50, "level", "spike"), (51, "level", "spike"), (80, "level", "spike"), (81, "level", "spike"), (120, "level", "impossible"), (121, "level", "impossible"), (250, "amount", "spike"), (251, "amount", "impossible")} | {(i, "level", "stuck") for i in range(201, 209)}
    assert flags(spark, rows + rows[:40]) == want  # redelivered rows change nothing
    assert flags(spark, rows, width=600) == want  # nor does cutting a source into small buckets
    assert flags(spark, rows, width=24_000, per_task=37) == want  # or dividing full ones


def test_spikes_do_not_depend_on_the_bucket_width(spark):
    rng = np.random.default_rng(1)
    near = lambda level, n: (level + rng.normal(0, 0.3, n)).tolist()
    x = near(100, 100) + near(150, 90) + [float("nan")] * 10 + near(100, 2) + near(150, 98)
    rows = [("a", i, i, v, None if 150 <= i < 260 else 5 + i % 3) for i, v in enumerate(x)]
    wide = flags(spark, rows, width=10_000)
    assert {(200, "level", "spike"), (201, "level", "spike")} <= wide
    for width in (100, 20, 7, 1):  # buckets without any usable reading among them
        assert flags(spark, rows, width=width) == wide
    # halts crowd nothing out of the context either
    y = [100.0, 101.0] * 30 + [107.0] * 5 + [107.0] * 40 + [107.0] + [100.0, 101.0] * 30
    rows = [("a", i, i, v, 0 if 65 <= i < 105 else 5 + i % 3) for i, v in enumerate(y)]
    wide = flags(spark, rows, width=10_000)
    assert (105, "level", "stuck") in wide
    for width in (50, 9, 1):
        assert flags(spark, rows, width=width) == wide


def test_fitted_tail_keeps_its_risk(spark):
    rng = np.random.default_rng(2)
    for draw in (rng.laplace, rng.normal):
        r = np.abs(draw(0, 1, 200_000))
        bins = np.round(np.log(r) * 20)
        _, at = np.unique(bins, return_inverse=True)
        n, s1, s2 = (np.bincount(at, w) for w in (np.ones(len(r)), r, r * r))
        z = spikes.tail_cutoff(s1 / n, n, s1, s2, 1e-3, 0.05)
        assert 0.4e-3 < np.mean(np.abs(draw(0, 1, 400_000)) > z) < 2e-3
    x = 100 + rng.laplace(0, 0.05, 12_000)
    planted = list(range(500, 12_000, 1000))
    for i in planted:
        x[i] += 3.0
    rows = [("a", i, i * 60, float(v), int(1000 * math.exp(rng.normal(0, 0.3))) * (40 if i == 777 else 1)) for i, v in enumerate(x)]
    got = flags(spark, rows, width=60_000, moves=None, times_volume=None)
    spiked = {i for i, f, _ in got if f == "level"}
    assert set(planted) <= spiked and len(spiked) <= len(planted) + 2 * 1e-3 * len(x)
    volumes = {i for i, f, r in got if (f, r) == ("amount", "spike")}
    assert 777 in volumes and len(volumes) <= 1 + 2 * 1e-3 * len(x)


def test_halt_is_no_case(spark):
    x = walk(100)
    x[40:60] = [x[40]] * 20
    rows = [("a", i, i * 60, v, 0 if 41 <= i < 60 else 100 + i % 5) for i, v in enumerate(x)]
    assert flags(spark, rows) == set()
    assert flags(spark, [(None, 1, 1, 1.0, 1), ("a", 2, None, 1.0, 1), ("a", 3, 3, None, None)]) == set()
    assert flags(spark, []) == set()


def test_regular_series(spark):
    t = lambda s: TS + dt.timedelta(seconds=s)
    s0 = int(TS.replace(tzinfo=dt.timezone.utc).timestamp())
    rows = [("a ", 1, t(10), s0 + 10, 5.0, 2), ("A", 2, t(20), (s0 + 20) * 1000, 6.0, 3), ("A", 2, t(20), (s0 + 20) * 1000, 6.0, 3), ("a", 3, t(1500), None, 7.0, None), ("a", 4, t(700), s0 + 700, float("nan"), 9), ("a", 5, t(4000), s0 + 4000, 8.0, 1), (None, 6, t(1), s0, 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, tick_id long, timestamp timestamp, timestamp_s long, price double, volume long")
    out = grid.regular_series(df, "symbol", "tick_id", grid.epoch_seconds(F.col("timestamp_s"), F.col("timestamp")), "price", "volume", F.unix_micros("timestamp"), max_gap=2).orderBy("slot_start_s").collect()
    assert [(r["slot_start_s"] - s0) // 300 for r in out] == list(range(14))
    assert (out[0]["open"], out[0]["close"], out[0]["volume"], out[0]["n"]) == (5.0, 6.0, 5, 2)
    assert [r["state"] for r in out[:6]] == ["observed", "filled", "filled", "missing", "missing", "observed"]
    assert out[1]["filled_price"] == 6.0 and out[3]["filled_price"] is None


def test_as_known_against_brute_force(spark):
    rng = random.Random(5)
    day = knowntime.DAY
    ev = [(rng.choice("ab"), i, rng.randint(0, 60) * day + rng.randint(0, day - 1)) for i in range(300)]
    ch = [(rng.choice("ab"), rng.choice(["split", "dividend", "other"]), i, rng.randint(0, 60) * day, rng.randint(0, 60) * day + rng.randint(0, day)) for i in range(80)]
    got = {tuple(r) for r in knowntime.as_known(spark.createDataFrame([*ev, *ev[:20], (None, 999, 5), ("a", 998, None)], "entity string, event_id long, at long"), spark.createDataFrame([*ch, *ch[:9], ("a", "split", 500, None, 3)], "entity string, kind string, change_id long, valid long, known long"), ["split", "dividend"], per_task=50).collect()}
    want = set()
    for e, i, at in ev:
        for k in ("split", "dividend"):
            ok = [(v, kn, c) for s, kk, c, v, kn in ch if s == e and kk == k and v <= at and kn <= at]
            if ok:
                want.add((i, k, max(ok)[2]))
    assert got == want


LINES = "stream string, file_no int, file_name string, file_date date, line_no int, line string"


def file_rows(stream, no, lines):
    return [(stream, no, f"{stream}_{no}", None, i + 1, x) for i, x in enumerate(lines)]


def test_drift_report_and_table(spark):
    a = ["timestamp,symbol,quantity,price", "1355803089,ABC,10,1.5", "1355803090,ABC,20,2.5", "1355803091,ABC,30,3.5", "1355803091,ABC,30,3.5"]
    b = ['﻿timestamp;"sym";quantity;price;venue', "1355803089;ABC;10 sh;1.50;X", "1355803090;ABC;20 sh;2.50;-", "1355803091;ABC;30 sh;3.50;X"]
    c = ['{"timestamp": 1355803089, "sym": "ABC", "price": 1.50, "weird": "10 sh"}', '{"timestamp": 1355803090, "sym": "ABC", "price": 2.5, "weird": "20 sh"}', '{"timestamp": 1355803091, "sym": "ABC", "price": 3.5, "weird": "30 sh"}']
    df = spark.createDataFrame(file_rows("s", 1, a) + file_rows("s", 2, b) + file_rows("s", 3, c) + file_rows("t", 1, [None, "", "a,b"]), LINES)
    got = sorted(tuple(r) for r in drift.drift_report(df).collect())
    assert got == [("s_2", "quantity", "retyped"), ("s_2", "sym", "renamed"), ("s_2", "venue", "added"), ("s_3", "venue", "removed"), ("s_3", "weird", "renamed")]
    table = drift.consistent_table(df).where("stream = 's'").collect()
    assert len(table) == 10 and {r["symbol"] for r in table} == {"ABC"} and sum(r["quantity"] for r in table) == 3 * 60 + 30
    assert {r["price"] for r in table} == {1.5, 2.5, 3.5} and all(r["timestamp"] is not None for r in table)


def test_drifted_scales_and_decimal_commas(spark):
    a = ["timestamp,cash,price", "1355803089,1500.25,227.08", "1355803090,1400.00,1200.50", "1355803091,1300.75,9.00"]
    b = ["timestamp;acct_cash;price", '1355803089000;150025;"227,08"', '1355803090000;140000;"1.200,50"', '1355803091000;130075;"9,00"']
    t = drift.consistent_table(spark.createDataFrame(file_rows("s", 1, a) + file_rows("s", 2, b), LINES)).orderBy("file_no", "line_no").collect()
    assert [(r["timestamp"], r["cash"], r["price"]) for r in t[:3]] == [(r["timestamp"], r["cash"], r["price"]) for r in t[3:]]
    assert [r["cash"] for r in t[3:]] == [1500.25, 1400.0, 1300.75] and t[4]["price"] == 1200.5


def test_drift_empty(spark):
    assert drift.drift_report(spark.createDataFrame([], LINES)).count() == 0


@pytest.mark.parametrize(("text", "value"), [("$1,795,220.41", 1795220.41), ("2.519.130,38", 2519130.38), ("227,08", 227.08), ("17 sh", 17.0), ("3.38 USD", 3.38), ("BUY", "BUY"), ("-", None), ("2012-12-18 03:58:09", 1355803089.0), ("1,200", 1200.0)])
def test_quantity_of(text, value):
    assert drift.quantity_of(text) == value


def test_edit_script_nested_move():
    old = drift.Schema(["a", "b.x", "b.y"], {}, last=[{"a": "1", "b.x": "q", "b.y": "7.5"}])
    new = drift.Schema(["a", "b.x", "c.y2"], {}, first=[{"a": "1", "b.x": "q", "c.y2": "7.5"}])
    assert ("move", "b.y", "c.y2") in drift.edit_script(old, new)


def schema(columns, rows, end):
    return drift.Schema(columns, {}, **{end: [dict(zip(columns, r)) for r in rows]})


def test_values_overrule_names():
    rows = [("1.5", "900.25"), ("2.5", "800.75"), ("3.5", "700.5")]
    swapped = drift.edit_script(schema(["px", "cash"], rows, "last"), schema(["px", "cash"], [r[::-1] for r in rows], "first"))
    assert sorted(swapped) == [("rename", "cash", "px"), ("rename", "px", "cash")]
    taken = drift.edit_script(schema(["qty"], [("10",), ("20",), ("30",)], "last"), schema(["shares", "qty"], [("10", "7"), ("20", "8"), ("30", "9")], "first"))
    assert sorted(taken, key=str) == [("add", None, "qty"), ("rename", "qty", "shares")]
    unknown = drift.edit_script(schema(["a", "b"], [], "last"), schema(["b", "a"], [], "first"))
    assert sorted(unknown) == [("keep", "a", "a"), ("keep", "b", "b")]


def test_objects_are_nodes():
    rows = [("7.5", "3", "X"), ("8.5", "4", "Y")]
    renamed = drift.edit_script(schema(["trade.px", "trade.qty", "trade.venue"], rows, "last"), schema(["deal.px", "deal.qty", "deal.venue"], rows, "first"))
    assert sorted(renamed) == [("keep", f"trade.{c}", f"deal.{c}") for c in ("px", "qty", "venue")] + [("rename_node", "trade", "deal")]
    wrapped = drift.edit_script(schema(["px", "qty"], [r[:2] for r in rows], "last"), schema(["trade.px", "trade.qty"], [r[:2] for r in rows], "first"))
    assert sorted(wrapped) == [("move", "px", "trade.px"), ("move", "qty", "trade.qty")]
    both = drift.edit_script(schema(["a", "a.b"], rows, "last"), schema(["a", "a.b"], rows, "first"))
    assert sorted(both) == [("keep", "a", "a"), ("keep", "a.b", "a.b")]
    assert drift.edit_script(schema([], [], "last"), schema(["x"], [], "first")) == [("add", None, "x")]


def test_report_of_nested_columns(spark):
    old = ['{"trade": {"px": 7.5, "qty": 3}, "v": "X"}', '{"trade": {"px": 8.5, "qty": 4}, "v": "Y"}']
    new = ['{"deal": {"px": 7.5}, "qty": 3, "v": "X"}', '{"deal": {"px": 8.5}, "qty": 4, "v": "Y"}']
    df = spark.createDataFrame(file_rows("s", 1, old) + file_rows("s", 2, new), LINES)
    assert sorted(tuple(r)[1:] for r in drift.drift_report(df).collect()) == [("deal", "renamed"), ("qty", "moved")]
    assert sorted(tuple(r)[1:] for r in drift.drift_report(df, written=True).collect()) == [("deal.px", "renamed"), ("qty", "renamed")]


def test_tree_distance_is_least():
    """Against all ways to pair the columns of flat schemas."""
    from itertools import permutations

    rng = random.Random(4)
    for _ in range(30):
        a, b = [f"c{i}" for i in range(rng.randint(0, 4))], [rng.choice(["c", "d"]) + str(i) for i in range(rng.randint(0, 4))]
        old = schema(a, [[str(rng.randint(1, 3)) for _ in a] for _ in range(2)], "last")
        new = schema(b, [[str(rng.randint(1, 3)) for _ in b] for _ in range(2)], "first")
        got = drift.TreeEdit(old, new).trees(drift.tree_of(a), drift.tree_of(b))[0]
        small, large, flip = (a, b, False) if len(a) <= len(b) else (b, a, True)
        cost = lambda x, y: min(drift.relabel_cost(y, x, old, new) if flip else drift.relabel_cost(x, y, old, new), 2.0)  # noqa: B023, E731
        want = min(sum(cost(x, y) for x, y in zip(small, p)) + len(large) - len(small) for p in permutations(large, len(small)))
        assert got == pytest.approx(want)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 5), (5, 2), (4, 4)):
        c = rng.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert sum(c[i, j] for i, j in drift.assign(c)) == pytest.approx(best)
