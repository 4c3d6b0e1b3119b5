"""Registered queries do the whole job: brute force on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import meta, signals, statarb, validate
from tickloom.plans import base, market as orders, research, sinks

DAY = dt.date(2020, 1, 1)


def fold(s, bands):
    ol, os, cl, cs = bands
    out, pos = [], 0
    for x in s:
        if x is None:
            pos = 0
        elif x < ol:
            pos = 1
        elif x > os:
            pos = -1
        elif not (pos == 1 and x <= cl or pos == -1 and x >= cs):
            pos = 0
        out.append(pos)
    return out


def s_scores(x, n):
    """(rows, names) of s-scores by numpy's own line fit; None before the window is full and where invalid."""
    out = [[None] * x.shape[1] for _ in x]
    for t in range(n - 1, len(x)):
        b = x[t - n + 1 : t + 1]
        resid, _, _ = statarb.residual_paths(b, statarb.keep_components(statarb.components(b)[0], n, "mp", 0.0))
        for j, path in enumerate(np.cumsum(resid, axis=0).T):
            slope, level = np.polyfit(path[:-1], path[1:], 1)
            if 0 < slope < 1 and -1 / np.log(slope) < 0.5 * n:
                var = ((path[1:] - slope * path[:-1] - level) ** 2).sum() / (n - 3)
                out[t][j] = (path[-1] - level / (1 - slope)) / np.sqrt(var / (1 - slope**2))
    return out


def pnl_of(pos, size, ret):
    """Paper profit per row of signed positions with sizes: half the gross a side, held from the second row after."""
    w = np.zeros(ret.shape)
    for t in range(len(ret)):
        lg, sh = size[t][pos[t] == 1].sum(), size[t][pos[t] == -1].sum()
        if lg > 0 and sh > 0:
            w[t] = np.where(pos[t] == 1, 0.5 * size[t] / lg, np.where(pos[t] == -1, -0.5 * size[t] / sh, 0.0))
    return np.concatenate([np.zeros(2), (w[:-2] * ret[2:]).sum(axis=1)])


@pytest.fixture
def market(spark, monkeypatch):
    """140 dates of six names, in place of the returns of the data."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (140, 1)) + rng.normal(0, 0.02, (140, 6))
    px = 100 * np.cumprod(1 + x, axis=0)
    data = [(DAY + dt.timedelta(days=t), f"S{j:02d}", float(x[t, j]), float(px[t, j])) for t in range(140) for j in range(6)]
    df = spark.createDataFrame(data, "date date, symbol string, ret double, close double").cache()
    monkeypatch.setattr(base, "returns", lambda spark, d: df)
    monkeypatch.setattr(base, "panel", lambda spark, d: df)
    return x, px


def test_sweep_covers_bands_and_windows(spark, market):
    x, _ = market
    got = {(r["window"], r["open_long"], r["open_short"], r["close_long"], r["close_short"]): r for r in research.v14_scored_sweep(spark, "").collect()}
    want = {}
    for n in (40, 60, 80):
        s = s_scores(x, n)
        for b in ((-1.25, 1.25, -0.5, 0.75), (-1.0, 1.0, -0.25, 0.5), (-1.5, 1.5, -0.75, 1.0), (-2.0, 2.0, -0.5, 0.5)):
            pos = np.array([fold([row[j] for row in s], b) for j in range(6)]).T
            p = pnl_of(pos, np.ones(x.shape), x)
            p = p[p != 0]
            want[(n, *b)] = (len(p), p.mean() / p.std(ddof=1) * 252**0.5 if len(p) > 1 else None)
    assert len(got) == 12 and got.keys() == want.keys()
    for k, (days, sharpe) in want.items():
        assert got[k]["days"] == days and got[k]["sharpe"] == (sharpe and pytest.approx(sharpe, rel=1e-6))


def test_book_follows_s_scores(spark, market):
    x, _ = market
    s = s_scores(x, 60)
    got = {(r["date"], r["symbol"]): r["pos"] for r in research.r25_r26_scored_book(spark, "").collect()}
    assert len(got) == 81 * 6
    for j in range(6):
        pos = fold([row[j] for row in s], (-1.25, 1.25, -0.5, 0.75))
        assert [got[DAY + dt.timedelta(days=t), f"S{j:02d}"] for t in range(59, 140)] == pos[59:]


def test_event_embargo_on_the_bar_axis(spark):
    from itertools import combinations

    rng = np.random.default_rng(5)
    t0 = np.sort(rng.integers(0, 400, 90))  # several events a bar, as of several names
    t1 = t0 + rng.integers(1, 8, 90)
    bars, pct = 410, 0.05
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(t0, t1))], "idx long, t0 long, t1 long")
    got = {(r["split_id"], r["idx"]): r["role"] for r in validate.purged_train(rows, spark, 90, 6, 2, pct, bars).collect()}
    grp, met = np.repeat(np.arange(6), 15), set()
    for s, chosen in enumerate(combinations(range(6), 2)):
        test = [i for i in range(90) if grp[i] in chosen]
        for i in range(90):
            if i in test:
                want = "test"
            elif any(t0[t] <= t1[i] and t1[t] >= t0[i] for t in test):
                want = "purged"
            elif any(t1[t] < t0[i] <= t1[t] + int(bars * pct) for t in test):
                want = "embargoed"
            else:
                want = "train"
            met.add(want)
            assert got[s, i] == want
    assert met == {"test", "purged", "embargoed", "train"}


def test_meta_splits_embargo_bars(spark, monkeypatch):
    """The registered splits ban what starts within int(bars / 100) bars after a test event, and nothing else."""
    rng = np.random.default_rng(6)
    s = rng.normal(0, 1.3, (300, 4))
    px = 100 * np.cumprod(1 + rng.normal(0, 0.2, (300, 4)), axis=0)
    data = [(DAY + dt.timedelta(days=t), f"S{j:02d}", float(s[t, j]), float(px[t, j])) for t in range(300) for j in range(4)]
    df = spark.createDataFrame(data, "date date, symbol string, s double, close double").cache()
    monkeypatch.setattr(research, "_zscores", lambda spark, d: df.select("date", "symbol", "s"))
    monkeypatch.setattr(base, "panel", lambda spark, d: df.select("date", "symbol", "close"))
    ev, roles = research._meta(spark, "")
    at = {r["event"]: (r["t0"], r["t1"]) for r in ev.collect()}
    role = {}
    for r in roles.collect():
        role.setdefault(r["split_id"], {})[r["event"]] = r["role"]
    banned = 0
    for split in role.values():
        ends = [at[e][1] for e, x in split.items() if x == "test"]
        for e, x in split.items():
            late = any(t < at[e][0] <= t + 3 for t in ends)
            if x in ("train", "embargoed"):
                assert (x == "embargoed") == late
                banned += late
    assert banned


def test_verdict_deflates_the_whole_meta_search(spark, market):
    from statistics import NormalDist

    x, _ = market
    law, names = NormalDist(), [f"S{j:02d}" for j in range(6)]
    positions, events = research._scored_events(spark, "")
    prob = {(r["symbol"], r["t0"]): r["p"] for r in events.collect()}
    assert len({round(p, 9) for p in prob.values()}) > 5
    at = {(r["symbol"], r["idx"]): r["pos"] for r in positions.collect()}
    pos = np.zeros(x.shape, int)
    for (symbol, i), v in at.items():
        pos[58 + i, names.index(symbol)] = v
    floors = (0.5, 0.52, 0.54, 0.56, 0.58, 0.6)
    configs = [("off", 0.0), *[("gate", f) for f in floors], *[("size", f) for f in floors]]
    series = []
    for mode, floor in configs:
        size = np.ones(x.shape)
        for j, symbol in enumerate(names):
            for t in range(59, 140):
                if pos[t, j] and pos[t, j] == pos[t - 1, j]:
                    size[t, j] = size[t - 1, j]
                elif mode != "off" and (symbol, t - 58) in prob:
                    p = prob[symbol, t - 58]
                    size[t, j] = float(p >= floor) if mode == "gate" else min(max((p - floor) / (1 - floor), 0.0), 1.0)
        series.append(pnl_of(pos, size, x))
    sr = [p.mean() / p.std(ddof=1) if p.std(ddof=1) > 0 else 0.0 for p in series]
    bar = np.std(sr, ddof=1) * ((1 - validate.EULER) * law.inv_cdf(1 - 1 / 13) + validate.EULER * law.inv_cdf(1 - 1 / (13 * np.e)))
    got = {(r["mode"], r["floor"]): r for r in research.l16_l17_deflated_verdict(spark, "").collect()}
    assert list(sorted(got)) == sorted(configs)
    for c, p, s in zip(configs, series, sr):
        z = (p - p.mean()) / p.std() if p.std() > 0 else None
        skew, kurt = ((z**3).mean(), (z**4).mean()) if z is not None else (0.0, 3.0)
        v = 1 - skew * s + (kurt - 1) / 4 * s * s
        assert got[c]["sharpe"] == pytest.approx(s * 252**0.5, rel=1e-6, abs=1e-9)
        assert got[c]["dsr"] == pytest.approx(law.cdf((s - bar) * (len(p) - 1) ** 0.5 / v**0.5), abs=1e-5)
        assert got[c]["psr"] == pytest.approx(law.cdf(s * (len(p) - 1) ** 0.5 / v**0.5), abs=1e-5)
    best = max(range(1, 13), key=lambda i: sr[i])
    assert {c: r["verdict"] for c, r in got.items() if r["verdict"]} == {("off", 0.0): "off", configs[best]: "best"}


def test_walk_forward_holds_21_dates(spark, monkeypatch):
    x = np.random.default_rng(8).normal(0, 0.01, (252 + 2 * 21 + 20, 3))
    v = spark.createDataFrame([(DAY + dt.timedelta(days=t), r.tolist()) for t, r in enumerate(x)], "date date, r array<double>")
    monkeypatch.setattr(research, "_vectors", lambda spark, d: v)
    got = research.p2_p4_walk_forward(spark, "").where("allocator = 'equal'").orderBy("date").collect()
    assert [r["rebalance"] for r in got] == [0] * 21 + [1] * 21  # the last 20 dates fill no block
    assert [r["ret"] for r in got] == pytest.approx(x[252:294].mean(axis=1).tolist())


def test_regimes_have_three_states_of_five_features_and_a_quarterly_refit(spark, monkeypatch):
    from tickloom.operators import regime

    rng, columns = np.random.default_rng(9), ["rv_long", "rv_short", "vov", "range_short", "volume_ratio"]
    x = np.repeat(rng.integers(0, 3, 40), 10)[:, None] * np.array([4.0, 0, 0, 0, 4.0]) + rng.normal(0, 0.3, (400, 5))
    f = spark.createDataFrame([(DAY + dt.timedelta(days=t), *map(float, r)) for t, r in enumerate(x)], "date date, " + ", ".join(f"{c} double" for c in columns))
    monkeypatch.setattr(research, "_market", lambda spark, d: f)
    got = {r["date"]: r for r in research.r30_r32_causal_states(spark, "").collect()}
    assert len(got) == 400 - 251 and {r["state"] for r in got.values()} == {0, 1, 2}
    for first in range(251, 400, 63):
        m, s = x[: first + 1].mean(axis=0), x[: first + 1].std(axis=0, ddof=1)
        model = regime.GaussianHmm(3).fit((x[: first + 1] - m) / s)
        end = min(first + 63, 400)
        p = model.filter((x[:end] - m) / s)[:, np.argsort(model.mean[:, 0], kind="stable")]
        for t in range(first, end):
            r = got[DAY + dt.timedelta(days=t)]
            assert r["state"] == p[t].argmax() and [r[f"p_state_{j}"] for j in range(3)] == pytest.approx(p[t].tolist(), abs=1e-9)


def test_bootstrap_draws_as_many_as_there_are_labels(spark, monkeypatch):
    labels = spark.createDataFrame([(n, 3 * i, 3 * i + 5) for n, k in (("A", 45), ("B", 7)) for i in range(k)], "symbol string, t0 long, t1 long")
    monkeypatch.setattr(research, "_labels", lambda spark, d: (labels, None))
    got = research.l6_sequential_bootstrap(spark, "").groupBy("symbol").agg(F.count("*").alias("n"), F.max("draw").alias("last")).collect()
    assert {r["symbol"]: (r["n"], r["last"]) for r in got} == {"A": (45, 44), "B": (7, 6)}


def test_importance_repeats_ten_times(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (60, 3))
    y = (x[:, 0] + rng.normal(0, 0.5, 60) > 0).astype(int)
    names = ["abs_s", "regime", "dow"]
    ev = spark.createDataFrame([(i, int(y[i]), 1.0, *map(float, x[i])) for i in range(60)], "event long, label int, weight double, abs_s double, regime double, dow double")
    roles = spark.createDataFrame([(0, i, "train" if i < 40 else "test") for i in range(60)], "split_id int, event long, role string")
    monkeypatch.setattr(research, "_meta", lambda spark, d: (ev, roles))
    model = meta.WeightedLogistic().fit(x[:40], y[:40].astype(float), np.ones(40))
    right = lambda z: ((model.predict(z) > 0.5) == (y[40:] > 0)).mean()
    draw, want = np.random.default_rng(0), {}
    for k, n in enumerate(names):
        loss = []
        for _ in range(10):
            z = x[40:].copy()
            z[:, k] = draw.permutation(z[:, k])
            loss.append(right(x[40:]) - right(z))
        want[n] = np.mean(loss)
    got = {r["feature"]: r["importance"] for r in research.l10_importance(spark, "").collect()}
    assert got == {n: pytest.approx(v, abs=1e-9) for n, v in want.items()} and got["abs_s"] > 0


def test_equity_of_all_accounts(spark, monkeypatch):
    data = [(a, DAY + dt.timedelta(days=t), 100.0 * a + t) for a in range(5) for t in range(3)]
    df = spark.createDataFrame(data, "account long, date date, equity double")
    monkeypatch.setattr(base, "equity", lambda spark, d: df)
    us = lambda day: (day - dt.date(1970, 1, 1)).days * 86_400_000_000
    want = sorted((a, us(day), v) for a, day, v in data)
    assert sorted((r["account"], r["ts_us"], r["equity"]) for r in orders.i25_loaded_accounts(spark, "").collect()) == want
    assert sorted((r["account"], r["timestamp"] * 1000, r["equity"]) for r in sinks.i19_account_sink(spark, "").collect()) == want


def test_orders_take_the_whole_book(spark, tmp_path):
    spark.createDataFrame([(k, 10.0, 10) for k in range(1, 13)], "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    # weight 0.005, position 0: 5000 of a million at 10 is 500 shares of every part
    assert {r["symbol"]: (r["side"], r["qty"]) for r in orders.t9_whole_orders(spark, str(tmp_path)).collect()} == {k: ("BUY", 500) for k in range(1, 13)}
    assert {r["symbol"]: r["qty"] for r in orders.t12_t14_whole_orders(spark, str(tmp_path)).collect()} == {k: 500 for k in range(1, 13)}


def test_absent_weights_and_holdings(spark):
    w = spark.createDataFrame([("A", 0.1), ("C", 0.1)], "symbol string, weight double")
    h = spark.createDataFrame([("A", 10), ("B", 20)], "symbol string, position int")
    p = spark.createDataFrame([(s, 10.0) for s in "ABCD"], "symbol string, price double")
    got = {r["symbol"]: (r["side"], r["qty"]) for r in signals.delta_orders(w, h, p, 700.0, 1.0).collect()}
    assert got == {"B": ("SELL", 20), "C": ("BUY", 10)}  # NAV 1000: A is on target, B leaves, C enters
    px = spark.createDataFrame([(s, t, 10.0) for s in "AB" for t in range(4)], "symbol string, date int, close double")
    books = spark.createDataFrame([("A", 0, 0.5), ("B", 0, 0.5), ("A", 2, 0.5), ("A", 3, 0.5), ("B", 3, 0.25)], "symbol string, date int, weight double")
    got = {(r["symbol"], r["date"]): (r["target"], r["trade"]) for r in signals.rebalance_trades(books, px, 1000.0).collect()}
    assert got == {("A", 0): (50, 50), ("A", 2): (50, 0), ("A", 3): (50, 0), ("B", 0): (50, 50), ("B", 2): (0, -50), ("B", 3): (25, 25)}
