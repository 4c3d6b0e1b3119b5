"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import code, micros, num
from tickloom.llm import encode, leaks, nearest, sentences
from tickloom.session import load


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    trades = load(spark, d, "tradelog").select(code("symbol").alias("entity"), F.col("trade_id").alias("left_id"), micros("timestamp").alias("at"))
    ticks = load(spark, d, "tick").where(num("price").isNotNull()).select(code("symbol").alias("entity"), F.col("tick_id").alias("right_id"), micros("timestamp").alias("at"))
    return nearest.nearest_in_time(trades, ticks, 2_000_000)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select(F.col("left_id").alias("trade_id"), F.col("right_id").alias("tick_id"))


def p3_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Per whole tenth of a second of the gap, how many trades were paired."""
    return _nearest(spark, d).groupBy(F.floor(F.col("gap_us") / 100_000).alias("tenths")).agg(F.count("*").alias("trades"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode_documents(spark, p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_gaps, p8_ids, p8_decoded, p9_found, p10_found)}

_SYM = "nullif(upper(trim(symbol, E' \\t\\r\\n')), '')"
_PAIRED = f"""WITH t AS (SELECT DISTINCT trade_id, {_SYM} AS symbol, epoch_us(timestamp) AS at FROM tradelog WHERE {_SYM} IS NOT NULL),
 k AS (SELECT DISTINCT tick_id, {_SYM} AS symbol, epoch_us(timestamp) AS at FROM tick WHERE {_SYM} IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)),
 n AS (SELECT trade_id, tick_id, abs(k.at - t.at) AS gap, row_number() OVER (PARTITION BY trade_id ORDER BY abs(k.at - t.at), k.at, tick_id) AS rn
  FROM t JOIN k ON t.symbol = k.symbol AND k.at BETWEEN t.at - 2000000 AND t.at + 2000000)"""
SQL = {
    "p3_found": f"{_PAIRED} SELECT trade_id, tick_id FROM n WHERE rn = 1",
    "p3_gaps": f"{_PAIRED} SELECT gap // 100000 AS tenths, count(*) AS trades FROM n WHERE rn = 1 GROUP BY 1",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
