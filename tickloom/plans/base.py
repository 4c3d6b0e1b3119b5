"""Base frames of the market queries, and the same frames as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import code
from tickloom.operators import bars as B
from tickloom.session import load

QUERIES: dict = {}
SQL: dict = {}


def eticks(spark: SparkSession, d: str) -> DataFrame:
    """The event stream read as a clean tick feed."""
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") + 1).alias("price"), (F.col("value") + 0.99).alias("bid"), (F.col("value") + 1.01).alias("ask"), (100 * (1 + F.col("user_id") % 9)).alias("bid_size"), (100 * (1 + F.col("event_id") % 7)).alias("ask_size"), (k + 1).alias("volume"))


ET = """et AS (SELECT event_type AS symbol, ts, event_id AS seq, value + 1 AS price, value + 0.99 AS bid, value + 1.01 AS ask, 100 * (1 + user_id % 9) AS bid_size, 100 * (1 + event_id % 7) AS ask_size,
 CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS volume FROM events)"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(eticks(spark, d), 3600)


HB = f"""{ET}, hb AS (SELECT symbol, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS bar_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM et GROUP BY 1, 2)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """A daily price panel of twelve names from line items: irregular, so that panels have gaps to fill."""
    li = load(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 12).cast("string"), 2, "0")).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.sum(F.col("l_quantity").cast("bigint")) / 10_000 + 10).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))


PX = """px AS (SELECT 'S' || lpad(CAST(l_suppkey % 12 AS VARCHAR), 2, '0') AS symbol, CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)) / 10000 + 10 AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.operators.clean import close_panel

    return close_panel(prices(spark, d))


PANEL = f"""{PX}, live AS (SELECT max(f) AS d0 FROM (SELECT min(date) AS f FROM px GROUP BY symbol)), grid AS (SELECT d.date, s.symbol FROM (SELECT DISTINCT date FROM px) d, (SELECT DISTINCT symbol FROM px) s),
 panel AS (SELECT * FROM (SELECT grid.date, grid.symbol, px.close IS NULL AS was_filled, last_value(px.close IGNORE NULLS) OVER w AS close, coalesce(last_value(px.volume IGNORE NULLS) OVER w, 0) AS volume
  FROM grid LEFT JOIN px ON grid.date = px.date AND grid.symbol = px.symbol WINDOW w AS (PARTITION BY grid.symbol ORDER BY grid.date)) WHERE date >= (SELECT d0 FROM live))"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.operators.clean import simple_returns

    return simple_returns(panel(spark, d))


RET = f"""{PANEL}, ret AS (SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM panel) WHERE ret IS NOT NULL)"""


def two_sides(spark: SparkSession, d: str) -> DataFrame:
    """Returns of two portfolios, the even and the odd names: for a universe of two all decompositions have closed forms."""
    odd = F.substring("symbol", 2, 9).cast("int") % 2 == 1
    return returns(spark, d).groupBy("date", F.when(odd, "odd").otherwise("even").alias("symbol")).agg(F.avg("ret").alias("ret"))


TS = f"""{RET}, ts AS (SELECT date, avg(ret) FILTER (WHERE CAST(substr(symbol, 2) AS INT) % 2 = 0) AS a, avg(ret) FILTER (WHERE CAST(substr(symbol, 2) AS INT) % 2 = 1) AS b FROM ret GROUP BY date),
 nt AS (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS total FROM ts)"""


def cross_section(spark: SparkSession, d: str) -> DataFrame:
    """Monthly cross-sections of suppliers: three factors and a return."""
    li, p = load(spark, d, "lineitem"), load(spark, d, "part")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))  # noqa: E731  exact sums, in any order
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("date"), F.col("l_suppkey").alias("symbol")).agg(
        (cents("l_discount") / F.count("*") / 100).alias("f1"), (F.sum("p_size") / F.count("*")).alias("f2"), (cents("p_retailprice") / F.count("*") / 100_000).alias("f3"), ((cents("l_tax") * 10 + cents("l_discount")) / F.count("*") / 1000 - 0.04).alias("ret"))


XS = """xs AS (SELECT strftime(l_shipdate, '%Y-%m') AS date, l_suppkey AS symbol, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100 AS f1, sum(p_size) / count(*) AS f2, sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) / 100000 AS f3,
 (sum(CAST(round(l_tax * 100) AS BIGINT)) * 10 + sum(CAST(round(l_discount * 100) AS BIGINT))) / count(*) / 1000 - 0.04 AS ret
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def ledger_trades(spark: SparkSession, d: str) -> DataFrame:
    """The trade log, once per trade: usable rows with absolute quantities."""
    t = load(spark, d, "tradelog").where("trade_id IS NOT NULL").groupBy("trade_id").agg(F.min(F.struct("timestamp", code("symbol").alias("symbol"), code("type").alias("type"), F.abs("quantity").alias("quantity"), "price")).alias("r"))
    return t.select(F.col("trade_id").alias("seq"), F.col("r.timestamp").alias("ts"), F.col("r.symbol").alias("symbol"), F.col("r.type").alias("type"), F.col("r.quantity").alias("quantity"), F.col("r.price").alias("price")).where("symbol IS NOT NULL AND type IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL")


_C = "nullif(upper(trim({0}, E' \\t\\r\\n')), '')"
TR = f"""tr AS (SELECT trade_id AS seq, any_value(timestamp) AS ts, any_value({_C.format('symbol')}) AS symbol, any_value({_C.format('type')}) AS type, any_value(abs(quantity)) AS quantity, any_value(price) AS price FROM tradelog GROUP BY trade_id
 HAVING any_value({_C.format('symbol')}) IS NOT NULL AND any_value({_C.format('type')}) IS NOT NULL AND any_value(price) IS NOT NULL AND any_value(quantity) IS NOT NULL)"""


def equity(spark: SparkSession, d: str) -> DataFrame:
    """Equity curves of five accounts from daily order flow."""
    o = load(spark, d, "orders")
    flow = o.groupBy((F.col("o_custkey") % 5).alias("account"), F.to_date("o_orderdate").alias("date")).agg((F.sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))) / 1000).alias("x"))
    from tickloom.functions.numeric import rows

    return flow.select("account", "date", (F.lit(100_000.0) + F.sum("x").over(rows("account", "date"))).alias("equity"))


EQ = """eq AS (SELECT account, date, 100000.0 + sum(x) OVER (PARTITION BY account ORDER BY date) AS equity FROM (SELECT o_custkey % 5 AS account, CAST(o_orderdate AS DATE) AS date, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) / 1000 AS x FROM orders GROUP BY 1, 2))"""


def iso(c: str = "date"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def r6(*names: str, digits: int = 6) -> list:
    return [(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names]


def q6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
