"""Queries of order books, microstructure and execution audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import normal_cdf, normal_cdf_sql
from tickloom.operators import book as K
from tickloom.operators import micro as M
from tickloom.operators import signals as S
from tickloom.plans import base
from tickloom.plans.base import ET, iso, q6, r6
from tickloom.session import load

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ order books: line items are resting orders

_REST = """rest AS (SELECT 'S' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'A' THEN 'BUY' ELSE 'SELL' END AS side, CAST(l_quantity AS BIGINT) + CASE WHEN l_returnflag = 'A' THEN 0 ELSE 50 END AS price, l_linenumber % 2 AS priority, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq,
 CAST(l_partkey % 9 + 1 AS BIGINT) AS size FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity, l_partkey FROM lineitem))"""


def _resting(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_partkey").distinct()
    buy = F.col("l_returnflag") == "A"
    return li.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol"), F.when(buy, "BUY").otherwise("SELL").alias("side"), (F.col("l_quantity").cast("bigint") + F.when(buy, 0).otherwise(50)).alias("price"), (F.col("l_linenumber") % 2).alias("priority"), (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), (F.col("l_partkey") % 9 + 1).cast("bigint").alias("size"), (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("string").alias("order_id"))


@query(f"WITH {ET}, q AS (SELECT symbol, arg_max(struct_pack(bid := bid, ask := ask, bid_size := bid_size, ask_size := ask_size), (ts, seq)) AS q FROM et GROUP BY symbol) SELECT symbol, round(q.bid, 6) AS bid, round(q.ask, 6) AS ask, q.bid_size AS bid_size, q.ask_size AS ask_size, round((q.bid + q.ask) / 2, 6) AS mid, round(q.ask - q.bid, 6) AS spread FROM q")
def o1_top_of_book(spark: SparkSession, d: str) -> DataFrame:
    return K.top_of_book(base.eticks(spark, d)).select("symbol", *r6("bid", "ask"), "bid_size", "ask_size", *r6("mid", "spread"))


@query(f"WITH {ET}, o AS (SELECT symbol, epoch_us(ts) // 3600000000 AS epoch, seq, volume AS qty, max(bid_size) OVER (PARTITION BY symbol, epoch_us(ts) // 3600000000) AS size FROM et) SELECT symbol, seq, CAST(least(qty, greatest(0, size - coalesce(sum(qty) OVER (PARTITION BY symbol, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS filled FROM o")
def o2_consumed_display(spark: SparkSession, d: str) -> DataFrame:
    e = base.eticks(spark, d).withColumn("epoch", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)).withColumnRenamed("volume", "qty")
    return K.consume_displayed(e.withColumn("size", F.max("bid_size").over(Window.partitionBy("symbol", "epoch")))).select("symbol", "seq", "filled")


@query(f"WITH {_REST}, lv AS (SELECT symbol, side, price, CAST(sum(size) AS BIGINT) AS size, count(*) AS orders FROM rest GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) AS INT) AS level FROM lv) WHERE level <= 5")
def o3_top_levels(spark: SparkSession, d: str) -> DataFrame:
    return K.top_levels(_resting(spark, d), 5)


@query(f"WITH {_REST} SELECT symbol, side, price, CAST(place AS INT) AS place, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side, price ORDER BY priority, seq) AS place FROM rest) GROUP BY ALL")
def o4_o5_queue_positions(spark: SparkSession, d: str) -> DataFrame:
    return K.queue_positions(_resting(spark, d)).groupBy("symbol", "side", "price", "place").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(f"WITH {_REST} SELECT symbol, side, price, count(*) AS orders, CAST(sum(size) AS BIGINT) AS size FROM rest WHERE seq % 7 <> 0 GROUP BY ALL")
def o6_after_cancels(spark: SparkSession, d: str) -> DataFrame:
    r = _resting(spark, d)
    return K.levels(K.without_cancelled(r, r.where("seq % 7 = 0").select("order_id"))).select("symbol", "side", "price", "orders", "size")


@query(f"WITH {_REST} SELECT symbol, side, price, seq, CAST(taken AS BIGINT) AS taken FROM (SELECT *, least(size, greatest(0, 40 - coalesce(sum(size) OVER (PARTITION BY symbol, side, price ORDER BY priority, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM rest) WHERE taken > 0")
def o7_o16_level_consumption(spark: SparkSession, d: str) -> DataFrame:
    return K.consume_level(_resting(spark, d), F.lit(40)).where("taken > 0").select("symbol", "side", "price", "seq", "taken")


@query(f"""WITH {_REST}, lv AS (SELECT symbol, price, sum(size) AS size FROM rest WHERE side = 'SELL' GROUP BY 1, 2), req AS (SELECT DISTINCT symbol, q AS qty FROM rest, (SELECT unnest([0, 500, 5000, 500000]) AS q)), w AS (SELECT req.symbol, qty, price, least(size, greatest(0, qty - coalesce(sum(size) OVER (PARTITION BY req.symbol, qty ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM req JOIN lv USING (symbol))
 SELECT symbol, qty, CAST(sum(taken) AS BIGINT) AS filled, round(coalesce(CASE WHEN sum(taken) > 0 THEN sum(taken * price) / sum(taken) END, 0), 6) AS vwap FROM w GROUP BY 1, 2""")
def o8_market_walk(spark: SparkSession, d: str) -> DataFrame:
    depth = K.levels(_resting(spark, d)).where("side = 'SELL'").withColumn("qty", F.explode(F.array(*[F.lit(x) for x in (0, 500, 5000, 500_000)])))
    return K.walk(depth, ["symbol", "qty"], order="price").select("symbol", "qty", "filled", *r6("vwap"))


_ORD = "ord AS (SELECT symbol || '-' || CAST(min(seq) AS VARCHAR) AS order_id, symbol, min(seq) AS submit_seq, arg_min(volume, seq) * 7 AS qty FROM et GROUP BY symbol, epoch_us(ts) // 3600000000)"
_NAIVE = f"""{ET}, {_ORD}, fl AS (SELECT ord.order_id, et.seq, et.volume, (et.bid + et.ask) / 2 AS mid, ord.qty, sum(et.volume) OVER (PARTITION BY ord.order_id ORDER BY et.seq) AS cum FROM ord JOIN et ON et.symbol = ord.symbol AND et.seq >= ord.submit_seq),
 fills AS (SELECT order_id, seq, CAST(least(qty, cum) - least(qty, cum - volume) AS BIGINT) AS fill, mid AS price FROM fl WHERE least(qty, cum) - least(qty, cum - volume) > 0)"""


def _opening(e: DataFrame) -> DataFrame:
    """The first tick of each symbol and hour: an order is sent with it."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return e.groupBy("symbol", hour.alias("hour")).agg(F.min_by(F.struct("seq", "price", "volume"), "seq").alias("t")).select("symbol", "hour", "t.*")


def _naive(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = base.eticks(spark, d)
    o = _opening(e).select(F.concat_ws("-", "symbol", "seq").alias("order_id"), "symbol", F.col("seq").alias("submit_seq"), (F.col("volume") * 7).alias("qty"))
    return K.naive_fills(o, e.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)), o


@query(f"WITH {_NAIVE} SELECT order_id, seq, fill, {q6('price')} FROM fills")
def o13_naive_fills(spark: SparkSession, d: str) -> DataFrame:
    return _naive(spark, d)[0].select("order_id", "seq", "fill", *r6("price"))


@query(f"WITH {_NAIVE} SELECT ord.order_id, CAST(coalesce(sum(fill), 0) AS BIGINT) AS filled, round(sum(fill * price) / sum(fill), 6) AS avg_price, CASE WHEN coalesce(sum(fill), 0) >= any_value(qty) THEN 'FILLED' WHEN coalesce(sum(fill), 0) > 0 THEN 'PARTIALLY_FILLED' ELSE 'PENDING' END AS status FROM ord LEFT JOIN fills USING (order_id) GROUP BY ord.order_id")
def o19_order_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.order_summary(*_naive(spark, d)).select("order_id", "filled", F.round("avg_price", 6).alias("avg_price"), "status")


@query(f"WITH {base.TR} SELECT seq, round(price + CASE WHEN type = 'BUY' THEN 1 ELSE -1 END * price * CASE WHEN symbol < 'M' THEN 0.00001 ELSE 0 END * quantity, 6) AS price FROM tr")
def o18_linear_slippage(spark: SparkSession, d: str) -> DataFrame:
    t = base.ledger_trades(spark, d)
    c = F.when(F.col("symbol") < "M", 0.00001)
    return t.select("seq", F.round(K.with_slippage(F.col("price"), c, F.col("quantity"), F.col("type")), 6).alias("price"))


@query(f"WITH {base.TR}, s AS (SELECT *, CASE WHEN type = 'BUY' THEN 1 ELSE -1 END AS g FROM tr) SELECT seq, CAST(sum(g * quantity) OVER (PARTITION BY symbol ORDER BY ts, seq) AS BIGINT) AS position, round(100000 - sum(g * quantity * price) OVER (PARTITION BY symbol ORDER BY ts, seq), 4) + 0.0 AS cash FROM s")
def o20_ledger(spark: SparkSession, d: str) -> DataFrame:
    f = base.ledger_trades(spark, d).select("seq", "ts", "symbol", F.col("type").alias("side"), F.col("quantity").alias("qty"), "price")
    return K.ledger(f, 100_000.0).select("seq", "position", *r6("cash", digits=4))


@query(f"""WITH RECURSIVE {base.TR}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i, quantity * price AS cost FROM tr), fold AS (SELECT i, symbol, seq, type <> 'BUY' OR cost <= 20000.0 AS accepted, CASE WHEN type <> 'BUY' THEN 20000.0 + cost WHEN cost <= 20000.0 THEN 20000.0 - cost ELSE 20000.0 END AS cash FROM n WHERE i = 1
 UNION ALL SELECT n.i, n.symbol, n.seq, n.type <> 'BUY' OR n.cost <= fold.cash, CASE WHEN n.type <> 'BUY' THEN fold.cash + n.cost WHEN n.cost <= fold.cash THEN fold.cash - n.cost ELSE fold.cash END FROM n JOIN fold ON n.symbol = fold.symbol AND n.i = fold.i + 1) SELECT seq, accepted, round(cash, 4) + 0.0 AS cash FROM fold""")
def o20_guarded_ledger(spark: SparkSession, d: str) -> DataFrame:
    f = base.ledger_trades(spark, d).select("seq", "ts", "symbol", F.col("type").alias("side"), F.col("quantity").alias("qty"), "price")
    return K.guarded_ledger(f, 20_000.0, "symbol").select("seq", "accepted", *r6("cash", digits=4))


@query(f"""WITH {ET}, f AS (SELECT symbol, min(seq) AS seq, CASE WHEN epoch_us(ts) // 3600000000 % 2 = 0 THEN 1 ELSE -1 END * arg_min(volume, seq) AS dq, arg_min(price, seq) AS price FROM et GROUP BY symbol, epoch_us(ts) // 3600000000), run AS (SELECT et.symbol, et.seq, et.price, sum(coalesce(dq, 0)) OVER w AS q, sum(coalesce(-dq * f.price, 0)) OVER w AS c FROM et LEFT JOIN f ON et.symbol = f.symbol AND et.seq = f.seq WINDOW w AS (PARTITION BY et.symbol ORDER BY et.seq))
 SELECT symbol, seq, round(10000 + c + q * price, 4) + 0.0 AS equity FROM run""")
def o22_equity_marks(spark: SparkSession, d: str) -> DataFrame:
    e = base.eticks(spark, d)
    f = _opening(e).select("symbol", "seq", F.when(F.col("hour") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("volume").alias("qty"), "price")
    return K.equity_curve(f, e, 10_000.0).select("symbol", "seq", *r6("equity", digits=4))


@query(f"""WITH {ET}, f AS (SELECT symbol, min(seq) AS seq, CASE WHEN epoch_us(ts) // 3600000000 % 2 = 0 THEN 1 ELSE -1 END * arg_min(volume, seq) AS dq, arg_min(price, seq) AS paid FROM et GROUP BY symbol, epoch_us(ts) // 3600000000), po AS (SELECT symbol, seq, sum(dq) OVER (PARTITION BY symbol ORDER BY seq) AS q FROM f), ca AS (SELECT seq, sum(-dq * paid) OVER (ORDER BY seq) AS c FROM f),
 sy AS (SELECT DISTINCT symbol FROM et), ts_ AS (SELECT et.symbol, et.seq, sy.symbol AS other FROM et, sy), pq AS (SELECT ts_.*, p.price FROM ts_ ASOF LEFT JOIN et p ON p.symbol = ts_.other AND ts_.seq >= p.seq), qq AS (SELECT pq.*, po.q FROM pq ASOF LEFT JOIN po ON po.symbol = pq.other AND pq.seq >= po.seq), vl AS (SELECT symbol, seq, sum(coalesce(price, 0) * coalesce(q, 0)) AS v FROM qq GROUP BY 1, 2)
 SELECT vl.symbol, vl.seq, round(10000 + coalesce(c, 0) + v, 4) + 0.0 AS equity FROM vl ASOF LEFT JOIN ca ON vl.seq >= ca.seq""")
def o22_portfolio_equity(spark: SparkSession, d: str) -> DataFrame:
    """One account over all symbols, marked on every tick."""
    e = base.eticks(spark, d)
    f = _opening(e).select("symbol", "seq", F.when(F.col("hour") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("volume").alias("qty"), "price")
    return K.portfolio_equity(f, e, 10_000.0).select("symbol", "seq", *r6("equity", digits=4))


@query(f"WITH {_NAIVE}, s AS (SELECT ord.order_id, CASE WHEN coalesce(sum(fill), 0) >= any_value(qty) THEN 'FILLED' WHEN coalesce(sum(fill), 0) > 0 THEN 'PARTIALLY_FILLED' ELSE 'PENDING' END AS status FROM ord LEFT JOIN fills USING (order_id) GROUP BY ord.order_id) SELECT order_id FROM s WHERE status IN ('PENDING', 'PARTIALLY_FILLED')")
def o23_active_orders(spark: SparkSession, d: str) -> DataFrame:
    return K.order_summary(*_naive(spark, d)).where("status IN ('PENDING', 'PARTIALLY_FILLED')").select("order_id")


def _order_stream(spark: SparkSession, d: str) -> DataFrame:
    e = base.eticks(spark, d).select("symbol", (F.col("seq") * 10).alias("seq"), F.lit("tick").alias("kind"), F.round("price", 2).alias("price"), "volume", F.round("bid", 2).alias("bid"), F.round("ask", 2).alias("ask"), "bid_size", "ask_size")
    src = _opening(base.eticks(spark, d))
    kind = F.element_at(F.array(F.lit("MARKET"), F.lit("LIMIT"), F.lit("IOC")), (F.col("hour") % 3 + 1).cast("int"))
    o = src.select("symbol", (F.col("seq") * 10 + 5).alias("seq"), F.lit("order").alias("kind"), F.concat_ws("-", "symbol", "seq").alias("order_id"), F.when(F.col("hour") % 2 == 0, "BUY").otherwise("SELL").alias("side"), kind.alias("order_type"), (F.col("volume") * 5).alias("qty"), F.round("price", 2).alias("limit_price"))
    c = src.select("symbol", (F.col("seq") * 10 + 1005).alias("seq"), F.lit("cancel").alias("kind"), F.concat_ws("-", "symbol", "seq").alias("order_id"))
    return e.unionByName(o, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query()
def o10_o21_book_replay(spark: SparkSession, d: str) -> DataFrame:
    """Orders of all kinds against the tick stream with first-in-first-out queues."""
    return K.replay_book(_order_stream(spark, d))


@query(f"WITH {ET}, o AS (SELECT DISTINCT symbol, epoch_us(ts) // 3600000000 AS hour FROM et) SELECT model, count(*) AS orders, CAST(0 AS BIGINT) AS overfilled, CAST(0 AS BIGINT) AS beyond_limit, CAST(0 AS BIGINT) AS before_order, CAST(0 AS BIGINT) AS after_cancel FROM o, (SELECT unnest(['full_depth', 'top_of_book', 'naive']) AS model) GROUP BY model")
def o10_o21_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every order in every model: no fill beyond its quantity or limit, before it came, or after its cancel."""
    stream = _order_stream(spark, d)
    orders = stream.where("kind = 'order'").select("order_id", F.col("seq").alias("came"), "side", "order_type", "qty", "limit_price")
    out = None
    for model in ("full_depth", "top_of_book", "naive"):
        f = K.replay_book(stream, model).select("order_id", "seq", F.col("qty").alias("n"), "price")
        m = orders.join(f, "order_id", "left")
        worse = (F.col("order_type") != "MARKET") & F.when(F.col("side") == "BUY", F.col("price") > F.col("limit_price") + 1e-9).otherwise(F.col("price") < F.col("limit_price") - 1e-9)
        g = m.groupBy("order_id").agg((F.sum("n") > F.first("qty")).cast("int").alias("over"), F.count_if(worse).alias("beyond"), F.count_if(F.col("seq") < F.col("came")).alias("before"), F.count_if(F.col("seq") > F.col("came") + 1000).alias("after"))
        one = g.agg(F.lit(model).alias("model"), F.count("*").alias("orders"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("over", "overfilled"), ("beyond", "beyond_limit"), ("before", "before_order"), ("after", "after_cancel"))])
        out = one if out is None else out.unionByName(one)
    return out


@query()
def o14_top_of_book_replay(spark: SparkSession, d: str) -> DataFrame:
    return K.replay_book(_order_stream(spark, d), "top_of_book")


# ------------------------------------------------------------------ order flow and toxicity

_OFI = f"""{ET}, pv AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_size) OVER w AS pbs, lag(ask_size) OVER w AS pas FROM et WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
 ev AS (SELECT *, CASE WHEN pb IS NOT NULL THEN (CASE WHEN bid > pb THEN bid_size WHEN bid < pb THEN -pbs ELSE bid_size - pbs END) + (CASE WHEN ask > pa THEN pas WHEN ask < pa THEN -ask_size ELSE pas - ask_size END) END AS e FROM pv), fl AS (SELECT *, CAST(sum(e) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 49 PRECEDING) AS BIGINT) AS ofi FROM ev)"""


@query(f"WITH {_OFI} SELECT seq, e, ofi FROM fl")
def m1_m2_flow(spark: SparkSession, d: str) -> DataFrame:
    return M.rolling_flow(M.flow_events(base.eticks(spark, d)), 50).select("seq", "e", "ofi")


@query(f"SELECT vec_id, round({normal_cdf_sql('x')}, 9) AS p FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS x FROM embeddings)")
def m3_normal_cdf(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.round(normal_cdf(F.col("embedding")[0].cast("double") * 4), 9).alias("p"))


_BUCK = """cv AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts, seq) AS cum FROM et WHERE volume > 0), bu AS (SELECT symbol, unnest(generate_series(CAST((cum - volume) // 400 + 1 AS BIGINT), CAST(cum // 400 AS BIGINT))) AS bucket, price, ts, seq FROM cv WHERE cum // 400 >= (cum - volume) // 400 + 1)"""
_VPIN = f"""{_BUCK}, dp AS (SELECT * FROM (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY bucket) AS dp FROM bu) WHERE dp IS NOT NULL), sg AS (SELECT *, coalesce(stddev_samp(dp) OVER (PARTITION BY symbol ORDER BY bucket), 0) AS sigma FROM dp),
 ib AS (SELECT *, CASE WHEN sigma > 0 THEN abs(2 * {normal_cdf_sql('(dp / nullif(sigma, 0))')} - 1) ELSE 0 END AS imbalance FROM sg), vp AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(imbalance) OVER w END AS vpin FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 9 PRECEDING))"""


@query(f"WITH {ET}, {_BUCK} SELECT symbol, bucket, {q6('price')}, seq FROM bu")
def m6_volume_buckets(spark: SparkSession, d: str) -> DataFrame:
    return M.volume_buckets(base.eticks(spark, d), 400).select("symbol", "bucket", *r6("price"), "seq")


@query(f"WITH {ET}, {_VPIN} SELECT symbol, bucket, {q6('sigma', 'imbalance', 'vpin')} FROM vp")
def m4_m7_vpin(spark: SparkSession, d: str) -> DataFrame:
    return M.vpin(M.volume_buckets(base.eticks(spark, d), 400), 10).select("symbol", "bucket", *r6("sigma", "imbalance", "vpin"))


_TOX = f"""{_OFI}, {_VPIN}, vt AS (SELECT symbol, seq, arg_max(vpin, bucket) AS v FROM vp WHERE vpin IS NOT NULL GROUP BY 1, 2), tx AS (SELECT fl.*, last_value(v IGNORE NULLS) OVER (PARTITION BY fl.symbol ORDER BY ts, fl.seq) AS vpin FROM fl LEFT JOIN vt ON vt.symbol = fl.symbol AND vt.seq = fl.seq)"""


@query(f"WITH {_TOX} SELECT seq, ofi, round(vpin, 6) + 0.0 AS vpin FROM tx")
def m8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return M.toxicity(base.eticks(spark, d), 400, 10).select("seq", "ofi", *r6("vpin"))


_SCHED = f"""{_TOX}, ah AS (SELECT *, (bid + ask) / 2 AS mid, min(price) OVER n AS lo, max(price) OVER n AS hi, lead(price, 5) OVER o AS later FROM tx WINDOW n AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), o AS (PARTITION BY symbol ORDER BY ts, seq)),
 nm AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM ah WHERE vpin IS NOT NULL AND later IS NOT NULL), so AS (SELECT *, CASE WHEN (i - 1) // 10 % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM nm WHERE (i - 1) % 10 = 0),
 sr AS (SELECT *, coalesce(vpin > 0.4 AND CASE WHEN side = 'BUY' THEN ofi < 0 ELSE ofi > 0 END, false) AS rested, CASE WHEN side = 'BUY' THEN lo <= mid - 0.05 ELSE hi >= mid + 0.05 END AS passive FROM so),
 au AS (SELECT symbol, seq, side, rested, rested AND passive AS filled_passive, 0.05 AS blind_slip, CASE WHEN NOT rested THEN 0.05 WHEN passive THEN -0.05 ELSE CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (later - mid) + 0.05 END AS filtered_slip FROM sr)"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return S.scheduled_orders(M.toxicity(base.eticks(spark, d), 400, 10), 10, 5, 0.05, 0.4)


@query(f"WITH {_SCHED} SELECT symbol, seq, side, rested, filled_passive, round(filtered_slip, 6) + 0.0 AS filtered_slip FROM au")
def t17_t18_scheduled_orders(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select("symbol", "seq", "side", "rested", "filled_passive", *r6("filtered_slip"))


@query(f"WITH {_SCHED} SELECT rested, filled_passive, count(*) AS orders, round(avg(blind_slip), 6) + 0.0 AS blind, round(avg(filtered_slip), 6) + 0.0 AS filtered FROM au GROUP BY 1, 2")
def e6_toxicity_summary(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).groupBy("rested", "filled_passive").agg(F.count("*").alias("orders"), F.avg("blind_slip").alias("blind"), F.avg("filtered_slip").alias("filtered")).select("rested", "filled_passive", "orders", *r6("blind", "filtered"))


# ------------------------------------------------------------------ execution audits

_SIZES = [100, 400, 1600, 6400, 25600]
_CURVE = f"""{ET}, hf AS (SELECT min(seq) AS seq, arg_min(price, seq) AS mid FROM et GROUP BY symbol, epoch_us(ts) // 3600000000), mids AS (SELECT seq AS sample, mid FROM hf), gr AS (SELECT *, CAST(unnest({_SIZES}) AS BIGINT) AS qty FROM (SELECT *, unnest(['uniform', 'linear']) AS profile FROM mids)), ld AS (SELECT *, unnest(generate_series(0, 299)) AS level FROM gr),
 lz AS (SELECT *, mid + 0.01 + level * 0.01 AS price, CASE WHEN profile = 'uniform' THEN 100 ELSE 100 * (level + 1) END AS size FROM ld), tk AS (SELECT *, least(size, greatest(0, qty - coalesce(sum(size) OVER (PARTITION BY profile, sample, qty ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM lz),
 cu AS (SELECT profile, sample, mid, qty, CAST(sum(taken) AS BIGINT) AS filled, sum(taken * price) / sum(taken) AS vwap FROM tk GROUP BY ALL), ip AS (SELECT *, (vwap - (mid + 0.01)) / (mid + 0.01) * 1e4 AS bps FROM cu)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    mids = _opening(base.eticks(spark, d)).select(F.col("seq").alias("sample"), F.col("price").alias("mid"))
    return K.impact_curve(mids, _SIZES, 300, 0.01, 0.01, 100)


@query(f"WITH {_CURVE} SELECT profile, sample, qty, filled, round(vwap, 6) AS vwap, round(bps, 4) + 0.0 AS bps FROM ip")
def e1_impact_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("profile", "sample", "qty", "filled", F.round("vwap", 6).alias("vwap"), *r6("bps", digits=4))


@query(f"WITH {_CURVE}, m AS (SELECT profile, qty, avg(bps) AS bps FROM ip GROUP BY 1, 2 HAVING avg(bps) > 1e-6 AND qty >= 400) SELECT profile, round(regr_slope(ln(bps), ln(qty)), 6) AS exponent, round(exp(regr_intercept(ln(bps), ln(qty))), 6) AS coefficient, round(regr_r2(ln(bps), ln(qty)), 6) AS r2 FROM m GROUP BY profile")
def e2_power_law(spark: SparkSession, d: str) -> DataFrame:
    return K.power_law(_curve(spark, d), least=400).select("profile", *r6("exponent", "coefficient", "r2"))



def _signals(spark: SparkSession, d: str) -> DataFrame:
    return S.long_flat(S.crossover(base.hourly(spark, d), 5, 20, guarded=True))


def _ab_sql(tail: str) -> str:
    from tickloom.plans.market import _CROSS

    return f"""WITH {_CROSS}, sg AS (SELECT symbol, bar_s, CASE WHEN guarded = 1 THEN 'BUY' ELSE 'SELL' END AS side, close, volume FROM flips), lv AS (SELECT *, unnest(generate_series(0, 12)) AS level FROM sg),
 tk AS (SELECT *, CASE WHEN side = 'BUY' THEN close + 0.01 * (level + 1) ELSE close - 0.01 * (level + 1) END AS price, least(volume, greatest(0, 2000 - level * volume)) AS taken FROM lv),
 dp AS (SELECT symbol, bar_s, side, close, CAST(sum(taken) AS BIGINT) AS filled, sum(taken * price) / sum(taken) AS vwap FROM tk GROUP BY ALL), pn AS (SELECT symbol, side, sum(filled * close * CASE WHEN side = 'BUY' THEN -1 ELSE 1 END) AS naive_pnl, sum(filled * vwap * CASE WHEN side = 'BUY' THEN -1 ELSE 1 END) AS depth_pnl, sum(filled) AS shares FROM dp GROUP BY 1, 2) {tail}"""


def _ab(spark: SparkSession, d: str) -> DataFrame:
    """The crossover's trades at the close and against 13 levels as thick as the bar's volume."""
    sig = _signals(spark, d).select("symbol", "bar_s", F.when(F.col("signal") == 1, "BUY").otherwise("SELL").alias("side"), "close", "volume", (F.col("close") - 0.01).alias("bid"), (F.col("close") + 0.01).alias("ask"), F.lit(2000).alias("qty"))
    depth = K.ladder(sig, 12, 0.01, F.col("volume"))
    return K.walk(depth, ["symbol", "bar_s", "side", "close", "qty"])


@query(_ab_sql("SELECT symbol, bar_s, side, filled, round(vwap, 6) AS vwap FROM dp"))
def e3_depth_audit(spark: SparkSession, d: str) -> DataFrame:
    return _ab(spark, d).select("symbol", "bar_s", "side", "filled", F.round("vwap", 6).alias("vwap"))


@query(_ab_sql("SELECT symbol, side, CAST(shares AS BIGINT) AS shares, round(naive_pnl, 2) AS naive_pnl, round(depth_pnl, 2) AS depth_pnl, round(naive_pnl - depth_pnl, 2) AS phantom, round((naive_pnl - depth_pnl) / shares, 6) AS per_share FROM pn"))
def e5_phantom(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("side") == "BUY", -1.0).otherwise(1.0)
    f = _ab(spark, d)
    naive = f.groupBy("symbol", "side").agg(F.sum(F.col("filled") * F.col("close") * sign).alias("naive_pnl"), F.sum("filled").alias("shares"))
    depth = f.groupBy("symbol", "side").agg(F.sum(F.col("filled") * F.col("vwap") * sign).alias("depth_pnl"))
    out = K.phantom_pnl(naive, depth, ["symbol", "side"]).withColumn("per_share", F.col("phantom") / F.col("shares"))
    return out.select("symbol", "side", "shares", *[F.round(c, 2).alias(c) for c in ("naive_pnl", "depth_pnl", "phantom")], F.round("per_share", 6).alias("per_share"))


def _e4_sql() -> str:
    from tickloom.plans.market import _WEIGHTS

    return f"""WITH {_WEIGHTS}, t AS (SELECT panel.date, panel.symbol, panel.close, panel.volume, CAST(sign(weight) * floor(abs(weight * 1e6 / close) + 0.5) AS BIGINT) AS target FROM panel JOIN wt USING (date, symbol)), tr AS (SELECT *, target - coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY date), 0) AS trade FROM t),
 lv AS (SELECT *, unnest(generate_series(0, 20)) AS level FROM tr WHERE trade <> 0), pr AS (SELECT *, sign(trade) AS g, close * 0.0001 AS h, greatest(0.01, close * 0.0002) AS gr, CASE WHEN level = 0 THEN 1 ELSE greatest(1, CAST(floor(30 * volume * 0.05 / 20) AS BIGINT)) END AS size FROM lv),
 tk AS (SELECT *, close + g * (h + level * gr) AS price, least(size, greatest(0, abs(trade) - coalesce(sum(size) OVER (PARTITION BY symbol, date ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM pr)
 SELECT strftime(date, '%Y-%m-%d') AS date, CAST(sum(taken) AS BIGINT) AS filled, round(sum(taken * (price - close) * g), 4) + 0.0 AS cost FROM tk GROUP BY 1"""


@query(_e4_sql())
def e4_statarb_audit(spark: SparkSession, d: str) -> DataFrame:
    from tickloom.plans.market import _weights

    p = base.panel(spark, d)
    tr = S.rebalance_trades(_weights(spark, d), p, 1e6).where("trade <> 0").join(p.select("date", "symbol", "close", "volume"), ["date", "symbol"])
    lad = tr.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("g", F.signum("trade"))
    grid = F.greatest(F.lit(0.01), F.col("close") * 0.0002)
    lad = lad.withColumn("price", F.col("close") + F.col("g") * (F.col("close") * 0.0001 + F.col("level") * grid)).withColumn("qty", F.abs("trade"))
    lad = lad.withColumn("size", F.when(F.col("level") == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(30 * F.col("volume") * 0.05 / 20))))
    f = K.walk(lad, ["symbol", "date", "close", "g", "qty"])
    return f.groupBy(iso()).agg(F.sum("filled").alias("filled"), F.sum(F.col("filled") * (F.col("vwap") - F.col("close")) * F.col("g")).alias("cost")).select("date", "filled", *r6("cost", digits=4))
