"""Round trips through the sinks: written to the shared folder, read back, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import base
from tickloom.plans.base import EQ, HB, TR, r6
from tickloom.plans.market import _WEIGHTS, _weights
from tickloom.sources import files as I
from tickloom.streaming import engine as E

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {HB} SELECT symbol, bar_s, round(close, 6) AS close, volume FROM hb")
def i16_partitioned_bars(spark: SparkSession, d: str) -> DataFrame:
    b = base.hourly(spark, d)
    folder = f"{E.shared_folder(spark)}/bars"
    I.write_partitioned(b, folder, "symbol")
    return spark.read.schema(b.schema).parquet(folder).select("symbol", "bar_s", F.round("close", 6).alias("close"), "volume")


@query(f"WITH {EQ} SELECT account, CAST(epoch_ms(CAST(date AS TIMESTAMP)) AS BIGINT) AS timestamp, round(equity, 4) AS equity FROM eq")
def i19_account_sink(spark: SparkSession, d: str) -> DataFrame:
    e = base.equity(spark, d).select("account", F.unix_millis(F.col("date").cast("timestamp")).alias("timestamp"), F.round("equity", 4).alias("equity"))
    folder = f"{E.shared_folder(spark)}/accounts"
    I.write_equity(e, folder, ("account",))
    return spark.read.csv(folder, schema="timestamp bigint, equity double, account bigint", header=True)


@query(f"WITH {TR} SELECT symbol, type, count(*) AS trades, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(price), 4) AS price FROM tr GROUP BY 1, 2")
def i20_i26_tradelog_sink(spark: SparkSession, d: str) -> DataFrame:
    t = base.ledger_trades(spark, d).select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "symbol", "type", "quantity", "price", F.lit(0.0).alias("cash"))
    folder = f"{E.shared_folder(spark)}/tradelog"
    I.write_tradelog(t, folder)
    back = I.load_tradelog(spark.read.csv(folder, header=True))
    return back.groupBy("symbol", "type").agg(F.count("*").alias("trades"), F.sum("quantity").alias("quantity"), F.round(F.sum("price"), 4).alias("price"))


_MONTHLY = f"{_WEIGHTS}, me AS (SELECT max(date) AS date FROM wt GROUP BY date_trunc('month', date)), mw AS (SELECT wt.* FROM wt JOIN me USING (date)), days AS (SELECT date, lead(date) OVER (ORDER BY date) AS exec_date FROM me)"


@query(f"WITH {_MONTHLY} SELECT strftime(exec_date, '%Y-%m-%d') AS exec_date, symbol, weight + 0.0 AS weight FROM mw JOIN days USING (date) WHERE exec_date IS NOT NULL")
def i21_i24_weight_files(spark: SparkSession, d: str) -> DataFrame:
    """The books of a monthly rebalance, a file per execution date."""
    folder = f"{E.shared_folder(spark)}/weights"
    w = _weights(spark, d)
    ends = w.groupBy(F.date_trunc("month", "date")).agg(F.max("date").alias("date")).select("date")
    I.write_execution_weights(w.join(ends, "date"), folder)
    back = spark.read.csv(folder, schema="symbol string, weight double, exec_date date", header=True)
    return I.usable_weights(back, strict=True).select(F.date_format("exec_date", "yyyy-MM-dd").alias("exec_date"), "symbol", *r6("weight", digits=9))


@query("SELECT event_type AS symbol, count(*) AS orders, CAST(sum(event_id) AS BIGINT) AS seqs FROM events GROUP BY 1")
def i30_live_sink(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a stream handed over batch by batch, each batch written as one idempotent partition."""
    from tickloom.plans.streams import _ticks

    folder = E.shared_folder(spark)
    E.run_each_batch(_ticks(spark, d).select("symbol", "seq"), folder, "live", lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/orders/batch={i}"))
    return spark.read.parquet(f"{folder}/orders").groupBy("symbol").agg(F.count("*").alias("orders"), F.sum("seq").alias("seqs"))
