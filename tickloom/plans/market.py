"""Queries of sources, cleaning, bars, indicators and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import rows
from tickloom.functions.scalars import code, micros
from tickloom.operators import bars as B
from tickloom.operators import clean as C
from tickloom.operators import signals as S
from tickloom.operators import windows as W
from tickloom import config, strategy
from tickloom.plans import base
from tickloom.plans.base import ET, HB, PANEL, PX, RET, TR, iso, q6, r6
from tickloom.session import load
from tickloom.sources import files as I

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SMA = "CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} ELSE 0.0 END"
_CROSS = f"""{HB}, sma AS (SELECT *, {_SMA.format(n=5)} AS s, {_SMA.format(n=20)} AS l FROM hb WINDOW w5 AS (PARTITION BY symbol ORDER BY bar_s ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY bar_s ROWS 19 PRECEDING)),
 lagged AS (SELECT *, lag(s) OVER w AS ps, lag(l) OVER w AS pl FROM sma WINDOW w AS (PARTITION BY symbol ORDER BY bar_s)),
 sig AS (SELECT *, CASE WHEN l > 0 AND pl > 0 AND ps <= pl AND s > l THEN 1 WHEN l > 0 AND pl > 0 AND ps >= pl AND s < l THEN -1 ELSE 0 END AS guarded, CASE WHEN l > 0 AND ps < pl AND s > l THEN 1 WHEN l > 0 AND ps >= pl AND s < l THEN -1 ELSE 0 END AS plain FROM lagged),
 flips AS (SELECT * FROM (SELECT *, coalesce(lag(guarded) OVER (PARTITION BY symbol ORDER BY bar_s), -1) AS before FROM sig WHERE guarded <> 0) WHERE guarded <> before)"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return base.hourly(spark, d)


@query(f"""WITH {_CROSS}, trades AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY bar_s) AS out_px FROM flips), pnl AS (SELECT symbol, bar_s, out_px / close - 1 AS ret FROM trades WHERE guarded = 1 AND out_px IS NOT NULL),
 curve AS (SELECT *, sum(ret) OVER (PARTITION BY symbol ORDER BY bar_s) AS cum FROM pnl), top AS (SELECT *, cum - greatest(max(cum) OVER (PARTITION BY symbol ORDER BY bar_s), 0) AS dd FROM curve)
 SELECT symbol, count(*) AS trades, round(sum(ret), 6) + 0.0 AS total, round(coalesce(avg(ret) / stddev_samp(ret), 0), 6) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS drawdown FROM top GROUP BY symbol""")
def flagship_crossover(spark: SparkSession, d: str) -> DataFrame:
    """Ticks to hourly bars, gated crossovers, round trips, and per-symbol performance: one lazy plan."""
    w = Window.partitionBy("symbol").orderBy("bar_s")
    flips = S.long_flat(S.crossover(_bars(spark, d), 5, 20, guarded=True)).withColumn("out_px", F.lead("close").over(w))
    pnl = flips.where("signal = 1 AND out_px IS NOT NULL").withColumn("ret", F.col("out_px") / F.col("close") - 1)
    pnl = pnl.withColumn("cum", F.sum("ret").over(rows("symbol", "bar_s"))).withColumn("dd", F.col("cum") - F.greatest(F.max("cum").over(rows("symbol", "bar_s")), F.lit(0.0)))
    out = pnl.groupBy("symbol").agg(F.count("*").alias("trades"), F.sum("ret").alias("total"), F.coalesce(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("sharpe"), F.min("dd").alias("drawdown"))
    return out.select("symbol", "trades", *r6("total", "sharpe", "drawdown"))


# ------------------------------------------------------------------ sources

def _tick_lines(spark: SparkSession, d: str, legacy: bool) -> DataFrame:
    t = base.eticks(spark, d)
    ms = F.floor(micros("ts") / 1000)
    stamp = F.when(F.col("seq") % 2 == 0, ms).otherwise(F.floor(ms / 1000)).cast("string")
    bad = F.col("seq") % 50 == 0
    price = F.when(bad, "n/a").otherwise(F.round("price", 2).cast("string"))
    cols = [stamp, price, F.col("volume").cast("string")] if legacy else [stamp, F.col("symbol"), price, F.col("volume").cast("string"), F.round("bid", 2).cast("string"), F.round("ask", 2).cast("string"), F.col("bid_size").cast("string"), F.col("ask_size").cast("string")]
    return t.select(F.concat_ws(",", *cols).alias("value"))


@query(f"WITH {ET} SELECT symbol, count(*) AS ticks, CAST(sum(volume) AS BIGINT) AS volume, round(sum(round(price, 2)), 2) AS px, CAST(sum(CASE WHEN seq % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 * 1000 END) AS BIGINT) AS ms, CAST(sum(bid_size + ask_size) AS BIGINT) AS sizes FROM et WHERE seq % 50 <> 0 GROUP BY symbol")
def i3_full_tick_lines(spark: SparkSession, d: str) -> DataFrame:
    t = I.parse_ticks(_tick_lines(spark, d, False)).where("NOT skipped")
    return t.groupBy("symbol").agg(F.count("*").alias("ticks"), F.sum("volume").alias("volume"), F.round(F.sum("price"), 2).alias("px"), F.sum(F.unix_millis("ts")).alias("ms"), F.sum(F.col("bid_size") + F.col("ask_size")).alias("sizes"))


@query(f"WITH {ET} SELECT 'UNKNOWN' AS symbol, count(*) AS ticks, round(sum(round(price, 2)) * 2, 2) AS quotes, CAST(sum(volume) * 2 AS BIGINT) AS sizes FROM et WHERE seq % 50 <> 0")
def i4_legacy_tick_lines(spark: SparkSession, d: str) -> DataFrame:
    t = I.parse_ticks(_tick_lines(spark, d, True)).where("NOT skipped")
    return t.groupBy("symbol").agg(F.count("*").alias("ticks"), F.round(F.sum(F.col("bid") + F.col("ask")), 2).alias("quotes"), F.sum(F.col("bid_size") + F.col("ask_size")).alias("sizes"))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 50 = 0) AS skipped FROM events")
def i6_skipped_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.skipped_rows(I.parse_ticks(_tick_lines(spark, d, False)))


@query("""SELECT count(*) AS bars, CAST(sum(timestamp) AS BIGINT) AS stamps, CAST(sum(volume) AS BIGINT) AS volume, round(sum(close), 2) AS close FROM (SELECT DISTINCT bar_id, timestamp, open, high, low, close, volume FROM test_data) WHERE close IS NOT NULL AND NOT isnan(close) AND volume IS NOT NULL""")
def i2_bar_lines(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "test_data").select("bar_id", "timestamp", "open", "high", "low", "close", "volume").distinct()
    lines = b.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in b.columns[1:]]).alias("value"))
    p = I.parse_bars(lines).where("NOT skipped AND NOT isnan(close)")
    return p.agg(F.count("*").alias("bars"), F.sum(F.unix_seconds("bar_ts")).alias("stamps"), F.sum("volume").alias("volume"), F.round(F.sum("close"), 2).alias("close"))


_GAPS = """steps AS (SELECT symbol, s - lag(s) OVER (PARTITION BY symbol ORDER BY s) AS d FROM (SELECT DISTINCT symbol, bar_s AS s FROM hb)), pos AS (SELECT * FROM steps WHERE d > 0), cnt AS (SELECT symbol, count(*) AS rows FROM (SELECT DISTINCT symbol, bar_s FROM hb) GROUP BY 1)"""


@query(f"""WITH {HB}, {_GAPS}, e AS (SELECT symbol, list_sort(list(d))[count(*) // 2 + 1] AS e FROM pos GROUP BY symbol)
 SELECT cnt.symbol, any_value(rows) AS rows, CAST(coalesce(sum(CASE WHEN d > e + e // 2 THEN (d + e // 2) // e - 1 END), 0) AS BIGINT) AS gaps FROM cnt LEFT JOIN pos ON cnt.symbol = pos.symbol LEFT JOIN e ON e.symbol = pos.symbol GROUP BY cnt.symbol""")
def i7_grid_gaps_upper(spark: SparkSession, d: str) -> DataFrame:
    return B.median_gap_count(_bars(spark, d), "symbol", "bar_s", True)


@query(f"""WITH {HB}, {_GAPS}, e AS (SELECT symbol, median(d) AS e FROM pos GROUP BY symbol)
 SELECT cnt.symbol, any_value(rows) AS rows, CAST(coalesce(sum(CASE WHEN round_even(d / e, 0) > 1 THEN round_even(d / e, 0) - 1 END), 0) AS BIGINT) AS gaps FROM cnt LEFT JOIN pos ON cnt.symbol = pos.symbol LEFT JOIN e ON e.symbol = pos.symbol GROUP BY cnt.symbol""")
def c2_grid_gaps_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return B.median_gap_count(_bars(spark, d), "symbol", "bar_s", False)


@query(f"WITH {ET} SELECT symbol, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT symbol, seq FROM et UNION ALL SELECT symbol, trade_id FROM (SELECT DISTINCT trade_id, nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol FROM tradelog)) WHERE symbol IS NOT NULL GROUP BY symbol")
def i9_merged_sources(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tradelog").select(F.col("trade_id").alias("seq"), code("symbol").alias("symbol")).distinct()
    return I.merge_sources(base.eticks(spark, d).select("symbol", "seq"), t.select("symbol", "seq")).where("symbol IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("seq").alias("seqs"))


@query(f"WITH {ET} SELECT symbol, count(*) AS rows, round(sum(round(price, 2)), 2) AS px FROM et GROUP BY symbol")
def i12_topic_messages(spark: SparkSession, d: str) -> DataFrame:
    t = base.eticks(spark, d).withColumn("price", F.round("price", 2))
    m = I.topic_lines(t, "TICK_DATA", ["symbol", "seq", "price", "volume"]).unionByName(I.topic_lines(t, "ORDER_DATA", ["symbol", "seq"]))
    return I.subscribe(m, "TICK_DATA", "symbol string, seq bigint, price double, volume bigint").groupBy("symbol").agg(F.count("*").alias("rows"), F.round(F.sum("price"), 2).alias("px"))


@query(f"""WITH {ET}, q AS (SELECT symbol, seq, epoch_us(ts) // 7200000000 AS stamp, CASE WHEN seq % 5 = 0 THEN 0.0 ELSE bid END AS bid, CASE WHEN seq % 7 = 0 THEN NULL ELSE ask END AS ask FROM et),
 n AS (SELECT *, lag(stamp) OVER w AS ps, row_number() OVER w AS i FROM q WINDOW w AS (PARTITION BY symbol ORDER BY seq))
 SELECT symbol, seq, round(CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 WHEN bid > 0 THEN bid ELSE ask END, 6) AS price FROM n WHERE (i = 1 OR stamp IS DISTINCT FROM ps) AND (bid > 0 OR ask > 0)""")
def i14_deduped_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = base.eticks(spark, d).select("symbol", "seq", F.floor(micros("ts") / 7_200_000_000).alias("stamp"), F.when(F.col("seq") % 5 == 0, 0.0).otherwise(F.col("bid")).alias("bid"), F.when(F.col("seq") % 7 != 0, F.col("ask")).alias("ask"))
    return I.dedupe_quotes(q).select("symbol", "seq", *r6("price"))


@query("""SELECT symbol, strftime(date, '%Y-%m-%d') AS date, volatility, epoch_us(ingested_at) AS at FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingested_at DESC) AS rn FROM (SELECT DISTINCT nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol, date, volatility, ingested_at FROM factor_data)) WHERE rn = 1""")
def i15_last_of_pages(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "factor_data").select(code("symbol").alias("symbol"), "date", "volatility", "ingested_at")
    return I.last_of(f, ["symbol", "date"], "ingested_at").select("symbol", iso(), "volatility", micros("ingested_at").alias("at"))


_WEIGHTS = f"""{PANEL}, sig AS (SELECT date, symbol, close - avg(close) OVER (PARTITION BY date) AS x FROM panel), wt AS (SELECT date, symbol, round(x / 1000, 6) AS weight FROM sig)"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    p = base.panel(spark, d)
    return p.select("date", "symbol", F.round((F.col("close") - F.avg("close").over(Window.partitionBy("date"))) / 1000, 6).alias("weight"))


@query(f"WITH {_WEIGHTS}, days AS (SELECT date, lead(date) OVER (ORDER BY date) AS exec_date FROM (SELECT DISTINCT date FROM wt)) SELECT strftime(exec_date, '%Y-%m-%d') AS exec_date, count(*) AS names, round(sum(abs(weight)), 8) AS gross FROM wt JOIN days USING (date) WHERE exec_date IS NOT NULL GROUP BY 1")
def i21_execution_weights(spark: SparkSession, d: str) -> DataFrame:
    return I.execution_weights(_weights(spark, d), 1).groupBy(iso("exec_date")).agg(F.count("*").alias("names"), F.round(F.sum(F.abs("weight")), 8).alias("gross"))


@query("SELECT l_orderkey AS id, l_linenumber AS symbol, l_quantity / 4 AS weight FROM lineitem WHERE l_quantity / 4 <= 10")
def i22_usable_weights(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("symbol"), (F.col("l_quantity") / 4).alias("weight"))
    return I.usable_weights(li)


@query("SELECT account, epoch_us(CAST(date AS TIMESTAMP)) AS ts_us, round(equity, 4) AS equity FROM (WITH " + base.EQ + " SELECT * FROM eq)")
def i25_loaded_accounts(spark: SparkSession, d: str) -> DataFrame:
    e = base.equity(spark, d).select("account", F.unix_millis(F.col("date").cast("timestamp")).alias("timestamp"), F.col("equity").alias("portfolio_value"))
    return I.load_equity(e, ("account",)).select("account", "ts_us", *r6("equity", digits=4))


@query("""SELECT regexp_extract(file_name, '^[a-z]+_([a-z]+)_', 1) AS strategy, regexp_extract(file_name, '\\.([a-z]+)$', 1) AS kind, count(DISTINCT file_name) AS files FROM tradelog_files GROUP BY 1, 2""")
def i27_discovered_runs(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "tradelog_files").select("file_name").distinct()
    return I.discover_runs(f).groupBy("strategy", "kind").agg(F.count("*").alias("files"))


@query("""SELECT '{"rows":' || count(*) || ',"first":"' || strftime(min(ts), '%Y-%m-%d') || '","symbols":' || count(DISTINCT event_type) || '}' AS manifest FROM events""")
def i31_manifest(spark: SparkSession, d: str) -> DataFrame:
    return I.manifest(base.eticks(spark, d), rows=F.count("*"), first=F.date_format(F.min("ts"), "yyyy-MM-dd"), symbols=F.count_distinct("symbol"))


@query("SELECT event_id AS seq, event_type AS symbol FROM events ORDER BY event_id LIMIT 1000")
def i32_head_subset(spark: SparkSession, d: str) -> DataFrame:
    return I.head_subset(base.eticks(spark, d).select("seq", "symbol"), "seq", 1000)


# ------------------------------------------------------------------ cleaning

_RAW = """raw AS (SELECT DISTINCT tick_id AS seq, nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol, timestamp AS ts, CASE WHEN isfinite(price) THEN price END AS price, volume FROM tick)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tick").select(F.col("tick_id").alias("seq"), code("symbol").alias("symbol"), F.col("timestamp").alias("ts"), "price", "volume").distinct()


@query(f"""WITH {_RAW} SELECT seq, symbol, price, volume FROM (SELECT seq, symbol, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq) AS price, coalesce(volume, 0) AS volume FROM raw) WHERE price IS NOT NULL""")
def c1_forward_filled(spark: SparkSession, d: str) -> DataFrame:
    return C.forward_fill(_raw(spark, d)).select("seq", "symbol", "price", "volume")


@query(f"""WITH {_RAW}, f AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq) AS p FROM raw) SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE price IS NULL) AS no_price, count(*) FILTER (WHERE volume IS NULL) AS no_volume, count(*) FILTER (WHERE p IS NULL) AS dropped FROM f GROUP BY symbol""")
def c1_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_report(_raw(spark, d))


_AC = """ac AS (SELECT symbol, date, action, max(value) AS value FROM (SELECT nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol, date, lower(trim(action, E' \\t\\r\\n')) AS action, value FROM corporate_actions WHERE value IS NOT NULL) GROUP BY 1, 2, 3)"""
_DAILY = """dc AS (SELECT symbol, CAST(make_timestamp(timestamp * 1000000) AS DATE) AS date, arg_max(close, (timestamp, bar_id)) AS close, CAST(sum(volume) AS DOUBLE) AS volume FROM (SELECT DISTINCT bar_id, nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol, timestamp, close, volume FROM test_data)
  WHERE isfinite(close) AND close > 0 GROUP BY 1, 2)"""


def _daily_actions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = load(spark, d, "test_data").select("bar_id", code("symbol").alias("symbol"), "timestamp", "close", "volume").distinct().where((F.col("close") > 0) & ~F.isnan("close"))
    px = b.groupBy("symbol", F.to_date(F.timestamp_seconds("timestamp")).alias("date")).agg(F.max_by("close", F.struct("timestamp", "bar_id")).alias("close"), F.sum("volume").cast("double").alias("volume"))
    ac = load(spark, d, "corporate_actions").where("value IS NOT NULL").groupBy(code("symbol").alias("symbol"), "date", F.lower(code("action")).alias("action")).agg(F.max("value").alias("value"))
    return px, ac


@query(f"""WITH {_DAILY}, {_AC}, f AS (SELECT ac.symbol, ac.date, ac.action, ac.value, (SELECT arg_max(close, dc.date) FROM dc WHERE dc.symbol = ac.symbol AND dc.date < ac.date) AS raw FROM ac),
 g AS (SELECT symbol, date, CASE WHEN action = 'split' AND value > 0 THEN 1 / value WHEN action = 'dividend' AND value > 0 AND value < raw THEN 1 - value / raw ELSE 1 END AS pf, CASE WHEN action = 'split' AND value > 0 THEN value ELSE 1 END AS vf FROM f)
 SELECT dc.symbol, strftime(dc.date, '%Y-%m-%d') AS date, round(dc.close * coalesce((SELECT product(pf) FROM g WHERE g.symbol = dc.symbol AND g.date > dc.date), 1), 4) + 0.0 AS close, round(dc.volume * coalesce((SELECT product(vf) FROM g WHERE g.symbol = dc.symbol AND g.date > dc.date), 1), 2) + 0.0 AS volume FROM dc""")
def c4_back_adjusted(spark: SparkSession, d: str) -> DataFrame:
    px, ac = _daily_actions(spark, d)
    return C.back_adjust(px, C.valid_actions(ac)).select("symbol", iso(), *r6("close", digits=4), *r6("volume", digits=2))


@query(f"WITH {PANEL} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, close, volume, was_filled FROM panel")
def c5_close_panel(spark: SparkSession, d: str) -> DataFrame:
    return base.panel(spark, d).select(iso(), "symbol", "close", "volume", "was_filled")


@query(f"WITH {RET} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('ret')} FROM ret")
def c7_simple_returns(spark: SparkSession, d: str) -> DataFrame:
    return base.returns(spark, d).select(iso(), "symbol", *r6("ret"))


@query(f"WITH {RET} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('ret')} FROM ret WHERE abs(ret) > 0.45")
def c8_extreme_returns(spark: SparkSession, d: str) -> DataFrame:
    return C.extreme_returns(base.returns(spark, d)).select(iso(), "symbol", *r6("ret"))


@query(f"WITH {PX} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, close, volume FROM (SELECT *, datediff('day', min(date) OVER (PARTITION BY symbol), date) AS age FROM px) WHERE close BETWEEN 24 AND 28 AND volume >= 50 AND age >= 252")
def c9_universe(spark: SparkSession, d: str) -> DataFrame:
    return C.universe(base.prices(spark, d), 24, 28, 50, 252).select(iso(), "symbol", "close", "volume")


@query("SELECT count(*) FILTER (WHERE price IS NOT NULL AND NOT isfinite(price)) AS bad_price, count(*) FILTER (WHERE bid IS NOT NULL AND NOT isfinite(bid)) AS bad_bid, bool_and(coalesce(isfinite(price), false) AND coalesce(isfinite(bid), false)) AS all_finite FROM tick")
def c11_nonfinite(spark: SparkSession, d: str) -> DataFrame:
    return C.nonfinite_count(load(spark, d, "tick"), "price", "bid")


@query("SELECT tick_id, CASE WHEN price IS NOT NULL AND NOT isfinite(price) THEN 0.0 ELSE price END AS price FROM (SELECT DISTINCT tick_id, price FROM tick)")
def c10_zeroed(spark: SparkSession, d: str) -> DataFrame:
    return C.zero_nonfinite(load(spark, d, "tick").select("tick_id", "price").distinct(), "price")


@query(f"WITH {PX} SELECT count(*) AS total, count(*) FILTER (WHERE close BETWEEN 24 AND 28 AND volume >= 50) AS kept, count(*) - count(*) FILTER (WHERE close BETWEEN 24 AND 28 AND volume >= 50) AS dropped FROM px")
def c12_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    p = base.prices(spark, d)
    return C.filter_stats(p, C.universe(p, 24, 28, 50))


@query(f"WITH {ET} SELECT seq, price FROM et WHERE symbol = 'click'")
def c13_symbol_predicate(spark: SparkSession, d: str) -> DataFrame:
    return base.eticks(spark, d).where("symbol = 'click'").select("seq", "price")


@query(f"WITH {HB}, sub AS (SELECT DISTINCT n_name AS strategy, ['click', 'view', 'error', 'signup', 'purchase'][1 + n_regionkey] AS symbol FROM nation) SELECT strategy, hb.symbol, count(*) AS bars FROM hb JOIN sub USING (symbol) GROUP BY 1, 2")
def c14_routed_bars(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("click", "view", "error", "signup", "purchase")])
    sub = load(spark, d, "nation").select(F.col("n_name").alias("strategy"), F.element_at(names, (F.col("n_regionkey") + 1).cast("int")).alias("symbol"))
    return C.route(_bars(spark, d), sub.unionAll(sub)).groupBy("strategy", "symbol").agg(F.count("*").alias("bars"))


@query("SELECT tick_id FROM (SELECT DISTINCT tick_id, price, bid, ask FROM tick) WHERE isfinite(price) AND isfinite(bid) AND isfinite(ask)")
def c15_complete_cases(spark: SparkSession, d: str) -> DataFrame:
    return C.complete_cases(load(spark, d, "tick").select("tick_id", "price", "bid", "ask").distinct(), "price", "bid", "ask").select("tick_id")


@query("SELECT nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol, round(avg(CAST(volatility IS NULL AS INT)), 6) AS missing FROM factor_data GROUP BY 1")
def c16_missing_share(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_share(load(spark, d, "factor_data").withColumn("symbol", code("symbol")), "symbol", "volatility").select("symbol", *r6("missing"))


@query(f"""WITH {_RAW}, {_AC}, ff AS (SELECT * FROM (SELECT seq, symbol, ts, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq) AS price, coalesce(volume, 0) AS volume FROM raw) WHERE price IS NOT NULL), td AS (SELECT symbol, CAST(ts AS DATE) AS date, arg_max(price, (ts, seq)) AS close, CAST(sum(volume) AS DOUBLE) AS volume FROM ff GROUP BY 1, 2),
 f AS (SELECT ac.*, (SELECT arg_max(close, td.date) FROM td WHERE td.symbol = ac.symbol AND td.date < ac.date) AS raw FROM ac), g AS (SELECT symbol, date, CASE WHEN action = 'split' AND value > 0 THEN 1 / value WHEN action = 'dividend' AND value > 0 AND value < raw THEN 1 - value / raw ELSE 1 END AS pf, CASE WHEN action = 'split' AND value > 0 THEN value ELSE 1 END AS vf FROM f)
 SELECT td.symbol, strftime(td.date, '%Y-%m-%d') AS date, round(td.close * coalesce((SELECT product(pf) FROM g WHERE g.symbol = td.symbol AND g.date > td.date), 1), 4) + 0.0 AS close, round(td.volume * coalesce((SELECT product(vf) FROM g WHERE g.symbol = td.symbol AND g.date > td.date), 1), 2) + 0.0 AS volume FROM td""")
def i18_ingestion_job(spark: SparkSession, d: str) -> DataFrame:
    _, ac = _daily_actions(spark, d)
    return I.process_ticks(_raw(spark, d).where("symbol IS NOT NULL"), ac).select("symbol", iso(), *r6("close", digits=4), *r6("volume", digits=2))


@query("SELECT count(*) AS bars, CAST(sum(timestamp) AS BIGINT) AS stamps, count(close) AS closes, CAST(sum(volume) AS BIGINT) AS volume FROM test_data")
def i8_parquet_bars(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "test_data")  # session zone
    b = I.read_parquet_bars(spark, f"{d}/test_data.parquet")
    return b.agg(F.count("*").alias("bars"), F.sum(F.unix_seconds("bar_ts")).alias("stamps"), F.count("close").alias("closes"), F.sum("volume").alias("volume"))


@query("SELECT nullif(upper(trim(symbol, E' \\t\\r\\n')), '') AS symbol, count(*) AS ticks, count(DISTINCT timestamp) AS instants FROM test_data GROUP BY 1")
def i17_bars_as_ticks(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "test_data")
    t = I.bars_as_ticks(I.read_parquet_bars(spark, f"{d}/test_data.parquet"))
    return t.groupBy(code("symbol").alias("symbol")).agg(F.count("*").alias("ticks"), F.count_distinct("ts").alias("instants"))


# ------------------------------------------------------------------ bars

@query(f"WITH {ET} SELECT symbol, CAST(epoch_us(ts) // 60000000 * 60 AS BIGINT) AS bar_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM et GROUP BY 1, 2")
def b1_minute_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(base.eticks(spark, d), 60)


@query(f"WITH {ET} SELECT symbol, CAST(epoch_us(ts) // 10000000 * 10 AS BIGINT) AS bar_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM et GROUP BY 1, 2")
def b5_ten_second_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(base.eticks(spark, d), 10)


@query(f"WITH {ET} SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, arg_max(price, seq) AS equity FROM et GROUP BY 1, 2")
def b6_daily_last(spark: SparkSession, d: str) -> DataFrame:
    return B.to_daily(base.eticks(spark, d).withColumnRenamed("price", "equity"), ("symbol",)).select("symbol", iso(), "equity")


@query(f"WITH {ET} SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(sum(volume) FILTER (WHERE symbol = 'click') AS BIGINT) AS click, CAST(sum(volume) FILTER (WHERE symbol = 'view') AS BIGINT) AS \"view\" FROM et GROUP BY 1")
def b7_quantity_by_day(spark: SparkSession, d: str) -> DataFrame:
    t = base.eticks(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "symbol", F.col("volume").alias("quantity"))
    return B.trades_by_day(t, ["click", "view"])


@query(f"WITH {TR} SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS trades FROM tr GROUP BY 1")
def b7_trades_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return B.trades_by_hour(base.ledger_trades(spark, d))


# ------------------------------------------------------------------ rolling and cross-sectional

def _w(n: int, name: str = "w") -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY bar_s ROWS {n - 1} PRECEDING)"


@query(f"WITH {HB} SELECT symbol, bar_s, round(CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w ELSE 0 END, 6) + 0.0 AS ma, round(CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w ELSE 0 END, 6) + 0.0 AS sd, round(coalesce(stddev_pop(close) OVER w, 0), 6) + 0.0 AS part, round(covar_pop(close, volume) OVER w, 6) + 0.0 AS cov, round(var_pop(close) OVER w, 6) + 0.0 AS var FROM hb WINDOW {_w(20)}")
def w1_w4_rolling(spark: SparkSession, d: str) -> DataFrame:
    k = ("symbol", "bar_s", 20)
    b = _bars(spark, d).withColumn("volume", F.col("volume").cast("double"))
    return b.select("symbol", "bar_s", W.moving_average("close", *k).alias("ma"), W.moving_deviation("close", *k).alias("sd"), W.rolling_deviation("close", *k).alias("part"), W.rolling_covariance("close", "volume", *k).alias("cov"), W.rolling_variance("close", *k).alias("var")).select("symbol", "bar_s", *r6("ma", "sd", "part", "cov", "var"))


_XW = f"""{base.XS}, lim AS (SELECT date, list_sort(list(f1)) AS v FROM xs GROUP BY date), xw AS (SELECT xs.*, least(greatest(f1, v[least(CAST(floor(len(v) * 0.05) AS INT) + 1, len(v))]), v[least(CAST(floor(len(v) * 0.95) AS INT) + 1, len(v))]) AS f1_w FROM xs JOIN lim USING (date))"""


@query(f"WITH {_XW} SELECT date, symbol, f1_w, round((f1_w - avg(f1_w) OVER w) / CASE WHEN stddev_pop(f1_w) OVER w = 0 THEN 1 ELSE stddev_pop(f1_w) OVER w END, 6) + 0.0 AS z FROM xw WINDOW w AS (PARTITION BY date)")
def w5_w6_winsorised_z(spark: SparkSession, d: str) -> DataFrame:
    x = W.winsorised(base.cross_section(spark, d), "f1", "date", 0.05)
    return x.withColumn("z", W.zscored("f1_w", "date")).select("date", "symbol", "f1_w", *r6("z"))


@query(f"WITH {RET}, z AS (SELECT date, symbol, CASE WHEN count(ret) OVER w = 60 AND stddev_samp(ret) OVER w > 0 THEN (ret - avg(ret) OVER w) / stddev_samp(ret) OVER w END AS z FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)) SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('z')} FROM (SELECT *, count(z) OVER (PARTITION BY date) = count(*) OVER (PARTITION BY date) AS ok FROM z) WHERE ok")
def w7_rolling_standardised(spark: SparkSession, d: str) -> DataFrame:
    return W.rolling_standardised(base.returns(spark, d), 60).select(iso(), "symbol", *r6("z"))


_PAIR = f"""{HB}, sp AS (SELECT 'p' AS pair, a.bar_s, a.close - 0.8 * b.close AS spread FROM hb a JOIN hb b ON a.bar_s = b.bar_s AND a.symbol = 'click' AND b.symbol = 'view'),
 zz AS (SELECT *, CASE WHEN count(spread) OVER w = 20 AND stddev_pop(spread) OVER w >= 1e-7 THEN (spread - avg(spread) OVER w) / stddev_pop(spread) OVER w END AS z, CASE WHEN count(spread) OVER v = 20 THEN (spread - avg(spread) OVER v) / stddev_samp(spread) OVER v END AS zc
 FROM sp WINDOW w AS (PARTITION BY pair ORDER BY bar_s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY pair ORDER BY bar_s ROWS 19 PRECEDING))"""


def _pair(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d)
    p = S.align_pairs(b.where("symbol = 'click'"), b.where("symbol = 'view'"), 0.8).withColumn("pair", F.lit("p"))
    return p.withColumn("z", W.spread_z("spread", "pair", "bar_s", 20)).withColumn("zc", W.spread_z("spread", "pair", "bar_s", 20, current=True))


@query(f"WITH {_PAIR} SELECT bar_s, {q6('spread', 'z', 'zc')} FROM zz")
def w8_w9_t5_spread_z(spark: SparkSession, d: str) -> DataFrame:
    return _pair(spark, d).select("bar_s", *r6("spread", "z", "zc"))


@query(f"""WITH RECURSIVE {_PAIR}, n AS (SELECT *, row_number() OVER (ORDER BY bar_s) AS i FROM zz), fold AS (SELECT i, bar_s, CAST(CASE WHEN abs(z) < 0.5 THEN 0 WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS INT) AS pos FROM n WHERE i = 1
 UNION ALL SELECT n.i, n.bar_s, CAST(CASE WHEN fold.pos = 0 THEN CASE WHEN n.z > 1 THEN -1 WHEN n.z < -1 THEN 1 ELSE 0 END WHEN abs(n.z) < 0.5 THEN 0 ELSE fold.pos END AS INT) FROM n JOIN fold ON n.i = fold.i + 1)
 SELECT bar_s, pos, pos * 100 AS qty_a, -pos * 80 AS qty_b FROM fold""")
def t6_pairs_machine(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_quantities(S.pairs_machine(_pair(spark, d), 1.0, 0.5), 0.8).select("bar_s", "pos", "qty_a", "qty_b")


@query(f"WITH {base.EQ}, r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY account ORDER BY date) - 1 AS ret FROM eq) SELECT account, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN count(ret) OVER w = 63 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END, 6) + 0.0 AS sharpe, round(equity / max(equity) OVER v - 1, 6) + 0.0 AS dd FROM r WINDOW w AS (PARTITION BY account ORDER BY date ROWS 62 PRECEDING), v AS (PARTITION BY account ORDER BY date)")
def w10_w11_rolling_sharpe(spark: SparkSession, d: str) -> DataFrame:
    e = base.equity(spark, d).withColumn("ret", F.col("equity") / F.lag("equity").over(Window.partitionBy("account").orderBy("date")) - 1)
    return e.select("account", iso(), W.rolling_sharpe("ret", "account", "date").alias("sharpe"), W.drawdown("equity", "account", "date").alias("dd")).select("account", "date", *r6("sharpe", "dd"))


_MKT = f"""{RET}, mk AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS mkt FROM ret), be AS (SELECT *, CASE WHEN count(mkt) OVER w >= 20 AND var_pop(mkt) OVER w <> 0 THEN 0.2 + 0.8 * covar_pop(ret, mkt) OVER w / var_pop(mkt) OVER w END AS beta FROM mk WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING))"""


@query(f"WITH {_MKT} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, round(beta, 6) + 0.0 AS beta, round(CASE WHEN beta IS NOT NULL THEN stddev_pop(coalesce(ret - beta * mkt, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) END, 6) + 0.0 AS resid_sigma FROM be")
def w12_w14_beta(spark: SparkSession, d: str) -> DataFrame:
    r = base.returns(spark, d).withColumn("mkt", F.avg("ret").over(Window.partitionBy("date")))
    return W.with_beta(r, "ret", "mkt", "symbol", "date", 60, 20, 0.2).select(iso(), "symbol", *r6("beta", "resid_sigma"))


@query(f"""WITH {RET}, a AS (SELECT *, CASE WHEN count(ret) OVER l = 21 THEN stddev_samp(ret) OVER l * sqrt(252) END AS rv_long, CASE WHEN count(ret) OVER s = 5 THEN stddev_samp(ret) OVER s * sqrt(252) END AS rv_short FROM ret WINDOW l AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING), s AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)),
 b AS (SELECT *, CASE WHEN count(rv_long) OVER l = 21 THEN stddev_samp(rv_long) OVER l END AS vov, CASE WHEN count(close) OVER s = 5 THEN (max(close) OVER s - min(close) OVER s) / avg(close) OVER s END AS range_short, CASE WHEN count(volume) OVER v = 63 THEN ln(nullif(volume, 0) / avg(volume) OVER v) END AS volume_ratio
 FROM a WINDOW l AS (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING), s AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), v AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING))
 SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('rv_long', 'rv_short', 'vov', 'range_short', 'volume_ratio')} FROM b WHERE vov IS NOT NULL AND range_short IS NOT NULL AND volume_ratio IS NOT NULL AND rv_short IS NOT NULL""")
def w15_regime_features(spark: SparkSession, d: str) -> DataFrame:
    return W.regime_features(base.returns(spark, d)).select(iso(), "symbol", *r6("rv_long", "rv_short", "vov", "range_short", "volume_ratio"))


_CUM = f"""{RET}, cu AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY date) AS cum FROM ret), mo AS (SELECT date, symbol, -(cum - lag(cum, 5) OVER w) AS reversal, lag(cum, 21) OVER w - lag(cum, 126) OVER w AS momentum FROM cu WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def _momentum(spark: SparkSession, d: str) -> DataFrame:
    c = W.with_cumulative_log(base.returns(spark, d))
    return c.select("date", "symbol", W.reversal_signal("symbol", "date", 5).alias("reversal"), W.skipped_momentum("symbol", "date", 126, 21).alias("momentum"))


@query(f"WITH {_CUM} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('reversal', 'momentum')} FROM mo")
def w16_w17_momentum(spark: SparkSession, d: str) -> DataFrame:
    return _momentum(spark, d).select(iso(), "symbol", *r6("reversal", "momentum"))


@query(f"""WITH {_CUM}, m6 AS (SELECT date, symbol, round(reversal, 9) AS x FROM mo), k AS (SELECT *, count(x) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date, x IS NOT NULL ORDER BY x, symbol) AS up, row_number() OVER (PARTITION BY date, x IS NOT NULL ORDER BY x DESC, symbol DESC) AS dn FROM m6)
 SELECT strftime(date, '%Y-%m-%d') AS date, symbol, CASE WHEN x IS NULL OR n < 2 THEN 0 WHEN dn <= least(greatest(1, CAST(round_even(n * 0.2, 0) AS INT)), n // 2) THEN 1 WHEN up <= least(greatest(1, CAST(round_even(n * 0.2, 0) AS INT)), n // 2) THEN -1 ELSE 0 END AS pos FROM k""")
def w18_rank_positions(spark: SparkSession, d: str) -> DataFrame:
    return W.rank_positions(_momentum(spark, d).withColumn("x", F.round("reversal", 9)), "x").select(iso(), "symbol", "pos")


_TRIO = f"""{RET}, tri AS (SELECT date, symbol, (close / lag(close, 59) OVER w - 1) - (close / lag(close, 19) OVER w - 1) AS momentum, CASE WHEN count(ret) OVER s = 20 THEN stddev_pop(ret) OVER s * sqrt(252) END AS vol, -(close / lag(close, 59) OVER w - 1) AS val FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date), s AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
 full_ AS (SELECT * FROM tri WHERE momentum IS NOT NULL AND vol IS NOT NULL), cmp AS (SELECT *, round(({' + '.join(f'({f} - avg({f}) OVER d) / CASE WHEN stddev_pop({f}) OVER d = 0 THEN 1 ELSE stddev_pop({f}) OVER d END' for f in ('momentum', 'vol', 'val'))}) / 3, 8) AS composite FROM full_ WINDOW d AS (PARTITION BY date)),
 tb AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY composite DESC, symbol) <= 3 THEN 1.0 / 3 WHEN row_number() OVER (PARTITION BY date ORDER BY composite, symbol) <= 2 THEN -1.0 / 3 ELSE 0.0 END AS w0 FROM cmp)"""


def _trio(spark: SparkSession, d: str) -> DataFrame:
    t = W.factor_trio(base.returns(spark, d)).where("momentum IS NOT NULL AND vol IS NOT NULL")
    return W.composite(t, ["momentum", "vol", "val"]).withColumn("composite", F.round("composite", 8))


@query(f"WITH {_TRIO} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('momentum', 'vol', 'val')}, composite FROM cmp")
def w19_w20_composite(spark: SparkSession, d: str) -> DataFrame:
    return _trio(spark, d).select(iso(), "symbol", *r6("momentum", "vol", "val"), "composite")


@query(f"""WITH {_TRIO}, tb3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY composite DESC, symbol) <= 3 THEN 1.0 / 3 WHEN row_number() OVER (PARTITION BY date ORDER BY composite, symbol) <= 3 THEN -1.0 / 3 ELSE 0.0 END AS w1 FROM cmp)
 SELECT strftime(date, '%Y-%m-%d') AS date, symbol, round(w1, 6) + 0.0 AS weight FROM tb3""")
def w21_top_bottom(spark: SparkSession, d: str) -> DataFrame:
    return W.top_bottom(_trio(spark, d), "composite", 3).select(iso(), "symbol", *r6("weight"))


_SIDE = f"""{_CUM}, wx AS (SELECT date, symbol, round(reversal, 6) AS weight FROM mo WHERE reversal IS NOT NULL), sd AS (SELECT *, sum(greatest(weight, 0)) OVER (PARTITION BY date) AS lg, sum(greatest(-weight, 0)) OVER (PARTITION BY date) AS sh FROM wx), sc AS (SELECT date, symbol, weight AS w0, CASE WHEN lg > 0 AND sh > 0 THEN least(lg, sh) / greatest(lg, sh) ELSE 1 END AS ratio FROM sd)"""


@query(f"WITH {_SIDE} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, round(CASE WHEN w0 > 0 THEN w0 * ratio ELSE w0 / ratio END, 8) + 0.0 AS weight, round(0.1 * 0.01 + 0.9 * w0, 8) + 0.0 AS damped FROM sc")
def w22_w23_balanced(spark: SparkSession, d: str) -> DataFrame:
    m = _momentum(spark, d).select("date", "symbol", F.round("reversal", 6).alias("weight")).where("weight IS NOT NULL").withColumn("damped", W.damped(F.lit(0.01), F.col("weight")))
    return W.balance_sides(m).select(iso(), "symbol", *r6("weight", "damped", digits=8))


@query(f"WITH {RET} SELECT strftime(date, '%Y-%m-%d') AS date, symbol FROM (SELECT date, symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM ret) WHERE i % 6 = 0")
def w24_rebalance_rows(spark: SparkSession, d: str) -> DataFrame:
    return W.rebalance_rows(base.returns(spark, d), 5).select(iso(), "symbol")


@query(f"WITH {TR}, s AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts, seq)) / 1e6 AS since FROM tr), q AS (SELECT *, CAST(sum(CASE WHEN since > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS BIGINT) AS session FROM s) SELECT symbol, session, count(*) AS trades, round(max(since), 3) + 0.0 AS longest FROM q GROUP BY 1, 2")
def w25_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = B.sessions(base.ledger_trades(spark, d))
    return s.groupBy("symbol", "session").agg(F.count("*").alias("trades"), (F.round(F.max("since_s"), 3) + F.lit(0.0)).alias("longest"))


@query(f"WITH {TR} SELECT seq, CAST(sum(quantity) OVER (PARTITION BY symbol ORDER BY ts, seq) AS BIGINT) AS cum_qty, CAST(sum(quantity) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 19 PRECEDING) AS BIGINT) AS recent_qty FROM tr")
def w26_cumulative_quantity(spark: SparkSession, d: str) -> DataFrame:
    return W.cumulative_quantity(base.ledger_trades(spark, d)).select("seq", "cum_qty", "recent_qty")


# ------------------------------------------------------------------ signals and sizing

@query(f"WITH {_CROSS} SELECT symbol, bar_s, plain AS signal FROM sig WHERE plain <> 0")
def t2_crossover(spark: SparkSession, d: str) -> DataFrame:
    return S.crossover(_bars(spark, d), 5, 20).where("signal <> 0").select("symbol", "bar_s", "signal")


@query(f"WITH {ET} SELECT symbol, CASE symbol WHEN 'click' THEN 0.002 WHEN 'view' THEN 0.001 ELSE 0.0 END AS coefficient, count(*) AS ticks, 'top_of_book' AS fill_model FROM et GROUP BY symbol")
def i28_backtest_config(spark: SparkSession, d: str) -> DataFrame:
    """A configuration as read, applied to every symbol; the unknown fill model falls back."""
    c = config.read(config.BacktestConfig, {"fill_model": "other", "slippage": {"click": 0.002, "view": 0.001}, "unknown": 1})
    of = F.create_map(*[F.lit(x) for kv in c.slippage.items() for x in kv])
    t = base.eticks(spark, d).groupBy("symbol").agg(F.count("*").alias("ticks"))
    return t.select("symbol", F.coalesce(of[F.col("symbol")], F.lit(0.0)).alias("coefficient"), "ticks", F.lit(c.fill_model).alias("fill_model"))


@query(f"WITH {_CROSS} SELECT symbol, bar_s, CASE WHEN guarded > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(100 AS BIGINT) AS qty, round(close, 6) AS close FROM flips")
def t1_signal_strategy(spark: SparkSession, d: str) -> DataFrame:
    """A strategy written as a plan, over bars."""
    return strategy.signal_orders(strategy.SmaCrossover(5, 20), _bars(spark, d), 100).select("symbol", "bar_s", "side", "qty", *r6("close"))


_RUN = f"{_CROSS}, lst AS (SELECT symbol, max(bar_s) AS last FROM hb GROUP BY symbol), lead_ AS (SELECT flips.symbol, bar_s, guarded, (SELECT min(seq) FROM et WHERE et.symbol = flips.symbol AND epoch_us(et.ts) // 1000000 >= flips.bar_s + 3600) AS seq FROM flips)"


@query(f"WITH {_RUN} SELECT symbol, seq, CASE WHEN guarded > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(100 AS BIGINT) AS qty FROM lead_ WHERE seq IS NOT NULL")
def t1_callback_strategy(spark: SparkSession, d: str) -> DataFrame:
    """The same strategy written with callbacks: its orders, on the tick that closes the bar."""
    e = strategy.backtest(base.eticks(spark, d), strategy.CallbackCrossover, 3600)
    return e.where("kind = 'order'").select("symbol", "seq", "side", "qty")


@query(f"WITH {HB} SELECT symbol, bar_s, {q6('open', 'high', 'low', 'close')}, volume FROM hb")
def t1_b3_backtest_bars(spark: SparkSession, d: str) -> DataFrame:
    """The bars of a run, those still open at its end flushed."""
    e = strategy.backtest(base.eticks(spark, d), strategy.Strategy, 3600)
    return e.where("kind = 'bar'").select("symbol", "bar_s", *r6("open", "high", "low", "close"), "volume")


@query(f"WITH {_CROSS} SELECT symbol, bar_s, guarded AS signal, round(close, 6) AS close FROM flips")
def t3_t4_gated_crossover(spark: SparkSession, d: str) -> DataFrame:
    return S.long_flat(S.crossover(_bars(spark, d), 5, 20, guarded=True)).select("symbol", "bar_s", "signal", *r6("close"))


@query(f"WITH {ET} SELECT symbol, min(seq) AS seq, 'BUY' AS side, 100 AS qty, arg_min(price, seq) AS price FROM et GROUP BY symbol")
def t7_first_tick_order(spark: SparkSession, d: str) -> DataFrame:
    return S.first_tick_orders(base.eticks(spark, d))


@query(f"WITH {HB} SELECT symbol, ticks, bars FROM (SELECT symbol, count(*) AS ticks FROM et GROUP BY 1) JOIN (SELECT symbol, count(*) AS bars FROM hb GROUP BY 1) USING (symbol)")
def t8_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.event_counts(base.eticks(spark, d), _bars(spark, d))


@query(f"WITH {ET} SELECT strftime(ts, '%Y-%m-%d') AS day, arg_min(symbol, seq) AS symbol, min(seq) AS seq FROM et GROUP BY 1")
def t10_first_of_day(spark: SparkSession, d: str) -> DataFrame:
    return S.first_of_day(base.eticks(spark, d)).select(iso("day"), "symbol", "seq")


@query(f"WITH {ET} SELECT seq FROM et WHERE hour(ts) = 15 AND abs(minute(ts) - 0) <= 1")
def t11_time_of_day(spark: SparkSession, d: str) -> DataFrame:
    return S.at_time_of_day(base.eticks(spark, d), 15, 0).select("seq")


@query(f"WITH {TR} SELECT symbol, CAST(sum(CASE WHEN type = 'BUY' THEN quantity ELSE -quantity END) AS BIGINT) AS position FROM tr GROUP BY symbol HAVING sum(CASE WHEN type = 'BUY' THEN quantity ELSE -quantity END) <> 0")
def t15_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.positions(base.ledger_trades(spark, d).select("symbol", F.col("type").alias("side"), F.col("quantity").alias("qty")))


_WHOLE = """bk AS (SELECT p_partkey AS symbol, p_retailprice AS price, ((p_size % 11) - 5) / 1000.0 AS weight, (p_size % 7) - 3 AS position FROM part)"""


def _whole_book(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = load(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), "p_size")
    return p.select("symbol", ((F.col("p_size") % 11 - 5) / 1000.0).alias("weight")), p.select("symbol", (F.col("p_size") % 7 - 3).alias("position")), p.select("symbol", "price")


@query(f"""WITH {_WHOLE}, live AS (SELECT * FROM bk WHERE (weight IS NOT NULL OR position IS NOT NULL) AND price > 0), nav AS (SELECT 1000000.0 + sum(coalesce(position, 0) * price) AS nav FROM live), o AS (SELECT symbol, coalesce(weight, 0) * nav - coalesce(position, 0) * price AS dollars, price FROM live, nav)
 SELECT symbol, CASE WHEN dollars > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(floor(abs(dollars / price)) AS BIGINT) AS qty FROM o WHERE abs(dollars) >= 50 AND floor(abs(dollars / price)) > 0""")
def t9_whole_orders(spark: SparkSession, d: str) -> DataFrame:
    return S.delta_orders(*_whole_book(spark, d), 1_000_000.0, 50.0)


@query(f"""WITH {_WHOLE}, t AS (SELECT symbol, coalesce(position, 0) AS position, weight * 1000000.0 / price AS target FROM bk WHERE weight IS NOT NULL AND price > 0), x AS (SELECT symbol, CAST(sign(target - position) * floor(abs((target - position) / 5) + 0.5) * 5 AS BIGINT) AS delta FROM t WHERE abs(target) <= 1e9)
 SELECT symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS qty, 'MARKET' AS order_type, 'PENDING' AS status FROM x WHERE delta <> 0 AND abs(delta) > 4""")
def t12_t14_whole_orders(spark: SparkSession, d: str) -> DataFrame:
    return S.submit_status(S.build_orders(S.target_deltas(*_whole_book(spark, d), 1_000_000.0, 5), 4))


@query(f"""WITH {_WEIGHTS}, days AS (SELECT DISTINCT date FROM wt), t AS (SELECT panel.date, panel.symbol, CAST(sign(coalesce(weight, 0)) * floor(abs(coalesce(weight, 0) * 1e6 / close) + 0.5) AS BIGINT) AS target FROM panel JOIN days USING (date) LEFT JOIN wt ON wt.date = panel.date AND wt.symbol = panel.symbol)
 SELECT strftime(date, '%Y-%m-%d') AS date, symbol, target, target - coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY date), 0) AS trade FROM t""")
def t16_whole_trades(spark: SparkSession, d: str) -> DataFrame:
    return S.rebalance_trades(_weights(spark, d), base.panel(spark, d), 1e6).select(iso(), "symbol", "target", "trade")



@query("""WITH s AS (SELECT lower(trim(status, E' \\t\\r\\n')) AS s FROM recon_venue) SELECT CASE WHEN s = 'partially_filled' THEN 'PARTIALLY_FILLED' WHEN s = 'filled' THEN 'FILLED' WHEN s IN ('canceled', 'cancelled', 'expired') THEN 'CANCELLED' WHEN s = 'rejected' THEN 'REJECTED' ELSE 'PENDING' END AS status, count(*) AS orders FROM s GROUP BY 1""")
def t21_venue_status(spark: SparkSession, d: str) -> DataFrame:
    """Order states of the venue in ours."""
    v = load(spark, d, "recon_venue").select(S.venue_status(F.lower(code("status"))).alias("status"))
    return v.groupBy("status").agg(F.count("*").alias("orders"))


@query(f"""WITH l AS (SELECT order_id, sum(local_fill_qty) AS q FROM (SELECT DISTINCT nullif(upper(trim(order_id, E' \\t\\r\\n')), '') AS order_id, local_fill_qty, updated_at FROM recon_local) GROUP BY 1), v AS (SELECT order_id, max(venue_fill_qty) AS f FROM (SELECT nullif(upper(trim(order_id, E' \\t\\r\\n')), '') AS order_id, venue_fill_qty FROM recon_venue) GROUP BY 1)
 SELECT v.order_id, coalesce(f, 0) AS filled_qty, CAST(coalesce(q, 0) AS BIGINT) AS local_qty, coalesce(q, 0) = coalesce(f, 0) AS matched FROM v LEFT JOIN l USING (order_id)""")
def t20_reconciled_fills(spark: SparkSession, d: str) -> DataFrame:
    fills = load(spark, d, "recon_local").select(code("order_id").alias("order_id"), F.col("local_fill_qty").alias("qty"), "updated_at").distinct()
    venue = load(spark, d, "recon_venue").groupBy(code("order_id").alias("order_id")).agg(F.max("venue_fill_qty").alias("filled_qty"))
    return S.reconcile_fills(fills, venue).select("order_id", F.coalesce("filled_qty", F.lit(0)).alias("filled_qty"), "local_qty", "matched")


@query(f"WITH {ET}, r AS (SELECT symbol AS order_id, seq, CAST(sum(CASE WHEN seq % 3 = 0 THEN volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY seq) AS BIGINT) AS filled_qty FROM et) SELECT order_id, seq, fill FROM (SELECT *, filled_qty - coalesce(lag(filled_qty) OVER (PARTITION BY order_id ORDER BY seq), 0) AS fill FROM r) WHERE fill > 0")
def t21_fill_increments(spark: SparkSession, d: str) -> DataFrame:
    e = base.eticks(spark, d).select(F.col("symbol").alias("order_id"), "seq", F.when(F.col("seq") % 3 == 0, F.col("volume")).otherwise(0).alias("v"))
    return S.fill_increments(e.withColumn("filled_qty", F.sum("v").over(rows("order_id", "seq")))).select("order_id", "seq", "fill")
