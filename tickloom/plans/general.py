"""Queries of the general data-processing problems over the market tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import code, micros, num
from tickloom.operators import drift, grid, knowntime, reconcile, spikes, trailing
from tickloom.session import load

RECON_FIELDS = [
    reconcile.Field("symbol", "symbol", "symbol", "code"),
    reconcile.Field("side", "side", "side", "code"),
    reconcile.Field("price", "price", "price", "number", 0.005),
    reconcile.Field("quantity", "quantity", "quantity"),
    reconcile.Field("fill_qty", "local_fill_qty", "venue_fill_qty"),
    reconcile.Field("status", "status", "status", "code"),
]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.differences(load(spark, d, "recon_local"), load(spark, d, "recon_venue"), "order_id", "updated_at", RECON_FIELDS)


def _held_factors(spark: SparkSession, d: str) -> DataFrame:
    """The factor rows that hold: the latest ingested of a symbol and date."""
    f = load(spark, d, "factor_data")
    row = F.struct("ingested_at", "volatility", "rolling_mean")
    held = f.select(code("symbol").alias("symbol"), "date", num("volatility").alias("volatility"), num("rolling_mean").alias("rolling_mean"), "ingested_at")
    return held.where("symbol IS NOT NULL AND date IS NOT NULL").groupBy("symbol", "date").agg(F.max(row).alias("r")).select("symbol", "date", "r.volatility", "r.rolling_mean")


def p2_volatility(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.trailing_totals(_held_factors(spark, d), "symbol", "date", "volatility", carry=("rolling_mean",))
    return out.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date_iso"), *[F.round(c, 9).alias(c) if c[0] in "tm" else F.col(c) for c in ("total_7", "n_7", "mean_7", "total_30", "n_30", "mean_30")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.trailing_totals(_held_factors(spark, d), "symbol", "date", "volatility", periods=(30,), carry=("rolling_mean",))
    wrong = F.coalesce(F.abs(F.col("rolling_mean") - F.col("mean_30")) > 1e-6, F.col("rolling_mean").isNull() != F.col("mean_30").isNull())
    return out.where(F.col("has_rows") & wrong).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date_iso"))


def p2_close(spark: SparkSession, d: str) -> DataFrame:
    bars = load(spark, d, "test_data").where("bar_id IS NOT NULL").groupBy("bar_id").agg(F.max(F.struct("symbol", "timestamp", "close")).alias("r"))
    rows = bars.select(code("r.symbol").alias("symbol"), F.to_date(F.timestamp_seconds("r.timestamp")).alias("date"), F.col("r.close").alias("close"))
    out = trailing.trailing_totals(rows, "symbol", "date", "close")
    return out.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date_iso"), *[F.round(c, 8).alias(c) if c[0] in "tm" else F.col(c) for c in ("total_7", "n_7", "mean_7", "total_30", "n_30", "mean_30")])


def _flags(spark: SparkSession, d: str, **rules: float | None) -> DataFrame:
    t, b = load(spark, d, "tick"), load(spark, d, "test_data")
    ticks = t.select(F.lit("tick").alias("table_name"), code("symbol").alias("symbol"), F.col("tick_id").alias("row_id"), micros("timestamp").alias("s"), F.col("price").alias("level"), F.lit(None).cast("bigint").alias("amount"))
    bars = b.select(F.lit("test_data").alias("table_name"), code("symbol").alias("symbol"), F.col("bar_id").alias("row_id"), (F.col("timestamp") * 1_000_000).alias("s"), F.col("close").alias("level"), F.col("volume").alias("amount"))
    return spikes.flag_readings(ticks.unionByName(bars), {"tick": 86_400_000_000, "test_data": 90 * 86_400_000_000}, per_second=1_000_000, **rules)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("field") == "amount", "volume").when(F.col("table_name") == "tick", "price").otherwise("close")
    return _flags(spark, d).select("table_name", "row_id", name.alias("field")).distinct()


def p4_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Readings beyond the fitted tail of their own source, at a risk of one in a thousand; no fixed multiples."""
    return _flags(spark, d, moves=None, times_volume=None).select("table_name", "row_id", "field", "reason").distinct()


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("field") == "amount", "volume").when(F.col("table_name") == "tick", "price").otherwise("close")
    return _flags(spark, d).groupBy("table_name", name.alias("field"), "reason").agg(F.count("*").alias("n"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tick")
    return grid.regular_series(t, "symbol", "tick_id", grid.epoch_seconds(F.col("timestamp_s"), F.col("timestamp")), "price", "volume", micros("timestamp"))


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).withColumn("mean_price", F.round("mean_price", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).where("state <> 'observed'").select("symbol", "slot_start_s")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(load(spark, d, "tradelog_files"), written=True)


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(load(spark, d, "tradelog_files"))


def _known_actions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    trades, acts = load(spark, d, "tradelog"), load(spark, d, "corporate_actions")
    ev = trades.select(code("symbol").alias("entity"), F.col("trade_id").alias("event_id"), micros("timestamp").alias("at"))
    ch = acts.where(num("value").isNotNull()).select(
        code("symbol").alias("entity"), F.lower(code("action")).alias("kind"), F.col("action_id").alias("change_id"), micros(F.col("date").cast("timestamp")).alias("valid"), micros("recorded_at").alias("known"), "value"
    )
    return knowntime.as_known(ev, ch, ["split", "dividend"]), trades, ch


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    known, _, _ = _known_actions(spark, d)
    return known.select(F.col("event_id").alias("trade_id"), F.col("change_id").alias("action_id"))


def p7_trades(spark: SparkSession, d: str) -> DataFrame:
    """Every trade beside the split and the dividend in force as they were known; NULL where none was."""
    known, trades, ch = _known_actions(spark, d)
    what = ch.groupBy("change_id").agg(F.max(F.struct(F.to_date(F.timestamp_micros("valid")).alias("date"), "value")).alias("w"))
    seen = known.join(what, "change_id").groupBy("event_id").agg(*[F.max(F.when(F.col("kind") == k, F.col(f"w.{c}"))).alias(f"{k}_{c}") for k in ("split", "dividend") for c in ("date", "value")])
    once = trades.where("trade_id IS NOT NULL").groupBy("trade_id").agg(F.min(F.struct("timestamp", code("symbol").alias("symbol"))).alias("r")).select("trade_id", F.col("r.symbol").alias("symbol"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return once.join(seen.withColumnRenamed("event_id", "trade_id"), "trade_id", "left").select("trade_id", "symbol", iso("split_date"), "split_value", iso("dividend_date"), "dividend_value")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_volatility, p2_close, p4_found, p4_outliers, p4_reasons, p5_found, p5_series, p6_found, p6_table, p7_found, p7_trades)}

_CODE = "nullif(upper(trim({0}, E' \\t\\r\\n')), '')"
_SYM = _CODE.format("symbol")
_LATEST = """{side} AS (SELECT * FROM (SELECT {key} AS k, {sym} AS symbol, {s} AS side, CASE WHEN isnan(price) THEN NULL ELSE price END AS price, quantity, {q} AS fill_qty, {st} AS status,
  row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC NULLS LAST, price DESC) AS rn FROM recon_{side}) WHERE rn = 1 AND k IS NOT NULL)"""


def _latest(side: str, q: str) -> str:
    return _LATEST.format(side=side, key=_CODE.format("order_id"), sym=_SYM, s=_CODE.format("side"), st=_CODE.format("status"), q=q)


_FACTORS = f"""held AS (SELECT * FROM (SELECT {_SYM} AS symbol, date, volatility, rolling_mean, row_number() OVER (PARTITION BY {_SYM}, date ORDER BY ingested_at DESC) AS rn FROM factor_data WHERE {_SYM} IS NOT NULL AND date IS NOT NULL) WHERE rn = 1)"""
_DENSE = """span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM held GROUP BY symbol),
 days AS (SELECT symbol, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span)"""


def _trail(value: str, digits: int) -> str:
    parts = []
    for p in (7, 30):
        w = f"OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL {p - 1} DAYS PRECEDING AND CURRENT ROW)"
        parts.append(f"round(coalesce(sum(s) {w}, 0), {digits}) AS total_{p}, CAST(sum(c) {w} AS BIGINT) AS n_{p}, round(CASE WHEN sum(c) {w} > 0 THEN coalesce(sum(s) {w}, 0) / sum(c) {w} END, {digits}) AS mean_{p}")
    return f"SELECT symbol, strftime(date, '%Y-%m-%d') AS date_iso, {', '.join(parts)} FROM (SELECT days.symbol, days.date, sum({value}) AS s, count({value}) AS c FROM days LEFT JOIN held USING (symbol, date) GROUP BY 1, 2)"


_TICKS = f"""once AS (SELECT tick_id, any_value({_SYM}) AS symbol, any_value(CASE WHEN timestamp_s >= 100000000000 THEN timestamp_s // 1000 WHEN timestamp_s IS NULL THEN epoch_us(timestamp) // 1000000 ELSE timestamp_s END) AS s,
  any_value(timestamp) AS ts, any_value(price) AS p, any_value(volume) AS v FROM tick WHERE {_SYM} IS NOT NULL AND price IS NOT NULL AND NOT isnan(price) GROUP BY tick_id),
 slots AS (SELECT symbol, s - s % 300 AS slot, count(*) AS n, arg_min(p, (ts, tick_id)) AS open, arg_max(p, (ts, tick_id)) AS close, avg(p) AS mean_price, CAST(sum(v) AS BIGINT) AS volume FROM once GROUP BY 1, 2),
 series AS (SELECT symbol, unnest(generate_series(min(slot), max(slot), 300)) AS slot FROM slots GROUP BY symbol, slot // 86400),
 met AS (SELECT series.symbol, series.slot, n, open, close, mean_price, volume, last_value(CASE WHEN n IS NOT NULL THEN series.slot END IGNORE NULLS) OVER w AS seen, last_value(close IGNORE NULLS) OVER w AS held
  FROM series LEFT JOIN slots ON series.symbol = slots.symbol AND series.slot = slots.slot WINDOW w AS (PARTITION BY series.symbol ORDER BY series.slot))"""

_ACTS = f"""trades AS (SELECT DISTINCT trade_id, {_SYM} AS symbol, timestamp FROM tradelog WHERE {_SYM} IS NOT NULL),
 acts AS (SELECT DISTINCT action_id, {_SYM} AS symbol, lower({_CODE.format("action")}) AS kind, date, recorded_at, value FROM corporate_actions WHERE value IS NOT NULL),
 best AS (SELECT trade_id, kind, action_id, date, value FROM (SELECT trade_id, kind, action_id, date, value, row_number() OVER (PARTITION BY trade_id, kind ORDER BY date DESC, recorded_at DESC, action_id DESC) AS rn
  FROM trades JOIN acts USING (symbol) WHERE kind IN ('split', 'dividend') AND date <= CAST(timestamp AS DATE) AND recorded_at <= timestamp) WHERE rn = 1)"""

def _cases() -> str:
    """p4 as a walk from reading to reading: ``base`` is the last sound one, k the length of a group that leaves it and returns."""
    side = "sign(m.level - w.base)"
    far = lambda x: f"({x} - w.base) * {side} > w.lim"
    over = lambda x, y: f"({x} - {y}) * {side} > w.lim"
    xs = ["m.level", "m.x1", "m.x2", "m.x3"]
    group = " ".join(f"WHEN {xs[k]} IS NOT NULL AND {' AND '.join([far(x) for x in xs[:k]] + [over(x, xs[k]) for x in xs[:k]])} THEN {k}" for k in (1, 2, 3))
    key = "PARTITION BY table_name, symbol"
    return f"""WITH RECURSIVE raw AS (SELECT DISTINCT 'tick' AS table_name, {_SYM} AS symbol, tick_id AS row_id, epoch_us(timestamp) AS s, price AS level, CAST(NULL AS BIGINT) AS amount FROM tick WHERE {_SYM} IS NOT NULL AND tick_id IS NOT NULL AND timestamp IS NOT NULL AND price IS NOT NULL
  UNION ALL SELECT DISTINCT 'test_data', {_SYM}, bar_id, timestamp * 1000000, close, volume FROM test_data WHERE {_SYM} IS NOT NULL AND bar_id IS NOT NULL AND timestamp IS NOT NULL AND (close IS NOT NULL OR volume IS NOT NULL)),
 ps AS (SELECT *, row_number() OVER ({key} ORDER BY s, row_id) AS i FROM raw WHERE level IS NOT NULL AND isfinite(level) AND level > 0),
 mv AS MATERIALIZED (SELECT *, lag(level) OVER o AS pl, lead(level) OVER o AS x1, lead(level, 2) OVER o AS x2, lead(level, 3) OVER o AS x3 FROM ps WINDOW o AS ({key} ORDER BY i)),
 us AS (SELECT table_name, symbol, 10 * median(abs(level - pl)) AS lim FROM mv WHERE pl IS NOT NULL GROUP BY 1, 2),
 walk AS (SELECT table_name, symbol, CAST(2 AS BIGINT) AS i, level AS base, lim, CAST(0 AS BIGINT) AS bad_from, 0 AS k FROM mv JOIN us USING (table_name, symbol) WHERE i = 1
  UNION ALL SELECT table_name, symbol, i + greatest(n, 1), CASE WHEN n > 0 THEN base ELSE level END, lim, i, n FROM (SELECT w.*, m.level, CASE WHEN abs(m.level - w.base) <= w.lim THEN 0 {group} ELSE 0 END AS n FROM walk w JOIN mv m ON m.table_name = w.table_name AND m.symbol = w.symbol AND m.i = w.i)),
 bad AS (SELECT table_name, symbol, unnest(generate_series(bad_from, bad_from + k - 1)) AS i FROM walk WHERE k > 0),
 halts AS (SELECT table_name, row_id FROM mv WHERE amount = 0 AND level = pl),
 lv AS (SELECT *, row_number() OVER o AS j, level IS DISTINCT FROM lag(level) OVER o AS new FROM mv ANTI JOIN halts USING (table_name, row_id) WINDOW o AS ({key} ORDER BY s, row_id)), lr AS (SELECT *, sum(CAST(new AS INT)) OVER ({key} ORDER BY j) AS g FROM lv), ls AS (SELECT *, count(*) OVER (PARTITION BY table_name, symbol, g) AS c FROM lr),
 am AS (SELECT * FROM raw WHERE amount IS NOT NULL), ty AS (SELECT table_name, symbol, 25 * median(amount) AS most FROM am GROUP BY 1, 2),
 av AS (SELECT *, row_number() OVER o AS j, amount IS DISTINCT FROM lag(amount) OVER o AS new FROM am ANTI JOIN halts USING (table_name, row_id) WINDOW o AS ({key} ORDER BY s, row_id)), ar AS (SELECT *, sum(CAST(new AS INT)) OVER ({key} ORDER BY j) AS g FROM av), as_ AS (SELECT *, count(*) OVER (PARTITION BY table_name, symbol, g) AS c FROM ar),
 cases AS (SELECT table_name, row_id, 'level' AS field, 'impossible' AS reason FROM raw WHERE level IS NOT NULL AND NOT (isfinite(level) AND level > 0)
  UNION ALL SELECT mv.table_name, row_id, 'level', 'spike' FROM mv JOIN bad ON bad.table_name = mv.table_name AND bad.symbol = mv.symbol AND bad.i = mv.i
  UNION ALL SELECT table_name, row_id, 'level', 'stuck' FROM ls WHERE c >= 6 AND NOT new UNION ALL SELECT table_name, row_id, 'amount', 'impossible' FROM am WHERE amount < 0
  UNION ALL SELECT am.table_name, row_id, 'amount', 'spike' FROM am JOIN ty USING (table_name, symbol) WHERE amount > most UNION ALL SELECT table_name, row_id, 'amount', 'stuck' FROM as_ WHERE c >= 6 AND NOT new),
 named AS (SELECT DISTINCT table_name, row_id, CASE WHEN field = 'amount' THEN 'volume' WHEN table_name = 'tick' THEN 'price' ELSE 'close' END AS field, reason FROM cases)"""


SQL = {
    "p1_found": f"""WITH {_latest("local", "local_fill_qty")}, {_latest("venue", "venue_fill_qty")},
 both_sides AS (SELECT coalesce(l.k, v.k) AS order_id, l.k IS NULL AS no_l, v.k IS NULL AS no_v, l.symbol IS DISTINCT FROM v.symbol AS a, l.side IS DISTINCT FROM v.side AS b,
  coalesce(abs(l.price - v.price) > 0.005, (l.price IS NULL) <> (v.price IS NULL)) AS c, l.quantity IS DISTINCT FROM v.quantity AS d, l.fill_qty IS DISTINCT FROM v.fill_qty AS e, l.status IS DISTINCT FROM v.status AS f
  FROM local l FULL JOIN venue v ON l.k = v.k)
 SELECT order_id, 'missing_local' AS difference FROM both_sides WHERE no_l UNION ALL SELECT order_id, 'missing_venue' FROM both_sides WHERE no_v
 UNION ALL SELECT order_id, 'symbol' FROM both_sides WHERE NOT no_l AND NOT no_v AND a UNION ALL SELECT order_id, 'side' FROM both_sides WHERE NOT no_l AND NOT no_v AND b
 UNION ALL SELECT order_id, 'price' FROM both_sides WHERE NOT no_l AND NOT no_v AND c UNION ALL SELECT order_id, 'quantity' FROM both_sides WHERE NOT no_l AND NOT no_v AND d
 UNION ALL SELECT order_id, 'fill_qty' FROM both_sides WHERE NOT no_l AND NOT no_v AND e UNION ALL SELECT order_id, 'status' FROM both_sides WHERE NOT no_l AND NOT no_v AND f""",
    "p2_found": f"""WITH {_FACTORS}, m AS (SELECT symbol, date, rolling_mean, avg(volatility) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS mean_30 FROM held)
 SELECT symbol, strftime(date, '%Y-%m-%d') AS date_iso FROM m WHERE coalesce(abs(rolling_mean - mean_30) > 1e-6, (rolling_mean IS NULL) <> (mean_30 IS NULL))""",
    "p2_volatility": f"WITH {_FACTORS}, {_DENSE} " + _trail("volatility", 9),
    "p2_close": f"WITH held AS (SELECT {_SYM} AS symbol, CAST(make_timestamp(timestamp * 1000000) AS DATE) AS date, CASE WHEN NOT isnan(close) THEN close END AS close FROM (SELECT DISTINCT bar_id, symbol, timestamp, close FROM test_data) WHERE {_SYM} IS NOT NULL), {_DENSE} " + _trail("close", 8),
    "p4_found": f"{_cases()} SELECT DISTINCT table_name, row_id, field FROM named",
    "p4_reasons": f"{_cases()} SELECT table_name, field, reason, count(*) AS n FROM named GROUP BY ALL",
    "p5_found": f"WITH {_TICKS} SELECT symbol, slot AS slot_start_s FROM met WHERE n IS NULL",
    "p5_series": f"""WITH {_TICKS} SELECT symbol, slot AS slot_start_s, coalesce(n, 0) AS n, open, close, round(mean_price, 6) AS mean_price, CASE WHEN n IS NULL THEN 0 ELSE volume END AS volume,
 CASE WHEN n IS NOT NULL THEN 'observed' WHEN slot - seen <= 900 THEN 'filled' ELSE 'missing' END AS state, CASE WHEN slot - seen <= 900 THEN held END AS filled_price FROM met""",
    "p7_found": f"WITH {_ACTS} SELECT trade_id, action_id FROM best",
    "p7_trades": f"""WITH {_ACTS} SELECT trade_id, symbol, strftime(max(CASE WHEN kind = 'split' THEN date END), '%Y-%m-%d') AS split_date, max(CASE WHEN kind = 'split' THEN value END) AS split_value,
 strftime(max(CASE WHEN kind = 'dividend' THEN date END), '%Y-%m-%d') AS dividend_date, max(CASE WHEN kind = 'dividend' THEN value END) AS dividend_value
 FROM (SELECT DISTINCT trade_id, {_SYM} AS symbol FROM tradelog) t LEFT JOIN best USING (trade_id) GROUP BY trade_id, symbol""",
}
