"""Reading and writing market files. Text formats are parsed as columns, so bad rows are counted, never lost."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import BAR, TRADELOG, WEIGHTS


def epoch_micros(raw: Column) -> Column:
    """Feed timestamps: below 1e10 they are seconds, else milliseconds."""
    return F.when(raw < F.lit(10_000_000_000), raw * 1_000_000).otherwise(raw * 1000)


def scaled_epoch_micros(raw: Column, largest: Column) -> Column:
    """Unit by the column's largest value: nano-, micro-, milliseconds or seconds."""
    return F.when(largest > 1e17, F.floor(raw / 1000)).when(largest > 1e14, raw).when(largest > 1e11, raw * 1000).otherwise(raw * 1_000_000).cast("bigint")


def parse_ticks(lines: DataFrame, column: str = "value", symbol: str = "UNKNOWN") -> DataFrame:
    """CSV tick lines to (TICK columns, skipped). Eight fields and more are full ticks, three to seven legacy ones.

    A legacy tick has bid = ask = price and sizes = volume. Lines that do not parse keep NULL fields and
    skipped = true; headers (no digit in the first field) are dropped, so are NULL lines.
    """
    f = F.split(F.col(column), ",")
    part = lambda i, t: F.try_element_at(f, F.lit(i)).try_cast(t)
    n = F.size(f)
    full = n >= 8
    pick = lambda a, b, t: F.when(full, part(a, t)).when(n >= 3, part(b, t))
    price, volume = pick(3, 2, "double"), pick(4, 3, "bigint")
    row = lines.where(F.col(column).isNotNull() & F.try_element_at(f, F.lit(1)).rlike("[0-9]")).select(
        F.when(full, F.try_element_at(f, F.lit(2))).otherwise(F.lit(symbol)).alias("symbol"),
        F.timestamp_micros(epoch_micros(part(1, "bigint"))).alias("ts"), F.lit(None).cast("bigint").alias("seq"), price.alias("price"),
        F.when(full, part(5, "double")).otherwise(price).alias("bid"), F.when(full, part(6, "double")).otherwise(price).alias("ask"),
        F.when(full, part(7, "bigint")).otherwise(volume).alias("bid_size"), F.when(full, part(8, "bigint")).otherwise(volume).alias("ask_size"), volume.alias("volume"),
    )
    return row.withColumn("skipped", F.col("ts").isNull() | F.col("price").isNull() | F.col("volume").isNull())


def parse_bars(lines: DataFrame, column: str = "value", symbol: str = "UNKNOWN") -> DataFrame:
    """CSV bar lines (seconds, open, high, low, close, volume) to (BAR columns, skipped)."""
    f = F.split(F.col(column), ",")
    part = lambda i, t: F.try_element_at(f, F.lit(i)).try_cast(t)
    row = lines.where(F.col(column).isNotNull() & ~F.lower(F.col(column)).contains("open")).select(
        F.lit(symbol).alias("symbol"), F.timestamp_seconds(part(1, "bigint")).alias("bar_ts"), *[part(i + 2, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close"))], part(6, "bigint").alias("volume"))
    return row.withColumn("skipped", F.greatest(*[F.col(c).isNull() for c in ("bar_ts", "open", "high", "low", "close", "volume")]))


def read_csv(spark: SparkSession, path: str, symbol: str = "UNKNOWN") -> DataFrame:
    """Ticks or bars, told apart by the header; good rows in order of time."""
    lines = spark.read.text(path)
    head = lines.head()
    if head is not None and "open" in head[0].lower():
        return parse_bars(lines, symbol=symbol).where("NOT skipped").drop("skipped").orderBy("bar_ts")
    return parse_ticks(lines, symbol=symbol).where("NOT skipped").drop("skipped").orderBy("ts")


def read_parquet_bars(spark: SparkSession, path: str, symbol: str = "UNKNOWN") -> DataFrame:
    """Bars with an integer ``timestamp`` in seconds; every row group is read."""
    df = spark.read.parquet(path)
    if "close" not in df.columns:
        raise ValueError("no bars: a close column is missing")
    name = F.col("symbol") if "symbol" in df.columns else F.lit(symbol)
    return df.select(name.alias("symbol"), F.timestamp_seconds("timestamp").alias("bar_ts"), *[F.col(c).cast(BAR[c].dataType) for c in ("open", "high", "low", "close", "volume")])


def skipped_rows(parsed: DataFrame) -> DataFrame:
    """One row: how many lines were read and how many skipped."""
    return parsed.agg(F.count("*").alias("lines"), F.count_if("skipped").alias("skipped"))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Several tick sources as one; order by (ts, seq) where an order is needed."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def pages_to_bars(spark: SparkSession, pages: Iterable[list[dict]], schema: str = "symbol string, date date, open double, high double, low double, close double, volume bigint") -> DataFrame:
    """Pages of a paginated bar feed (any iterator); of a symbol and date the last bar read holds."""
    rows = [(*[bar.get(c.split()[0]) for c in schema.split(", ")], i) for i, bar in enumerate(b for page in pages for b in page)]
    if not rows:
        raise ValueError("the feed returned no bars")
    df = spark.createDataFrame(rows, schema + ", at bigint")
    return last_of(df, ["symbol", "date"], "at").drop("at")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    held = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"))
    return held.select(*keys, *[F.col(f"r.{c}") for c in (order, *rest)])


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_weights(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A weights file. Lenient: weights that are not finite or beyond 10 are dropped; strict: they fail."""
    df = spark.read.csv(path, schema=WEIGHTS, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return usable_weights(df, strict)


def usable_weights(df: DataFrame, strict: bool = False) -> DataFrame:
    w = F.col("weight")
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    if strict:
        return df.withColumn("weight", F.when(finite, w).otherwise(F.raise_error(F.lit("a weight is not finite"))))
    return df.where(finite & (F.abs(w) <= 10))


def execution_weights(weights: DataFrame, lag: int) -> DataFrame:
    """Weights as files of the day they are traded: each date's book is stamped ``lag`` dates later."""
    from pyspark.sql import Window

    days = weights.select("date").distinct().withColumn("exec_date", F.lead("date", lag).over(Window.orderBy("date")))
    return weights.join(days.where("exec_date IS NOT NULL"), "date").select("exec_date", "symbol", "weight")


def write_execution_weights(weights: DataFrame, path: str, lag: int = 1) -> None:
    # one file per date
    execution_weights(weights, lag).repartition("exec_date").write.mode("overwrite").partitionBy("exec_date").csv(path, header=True)


def load_equity(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ts_us, equity) from any of the three column names; of equal timestamps of a curve the last row holds."""
    name = next((c for c in ("equity", "portfolio_value", "value") if c in df.columns), None)
    if name is None or "timestamp" not in df.columns:
        raise ValueError("an equity file needs timestamp and one of equity, portfolio_value, value")
    order = "seq" if "seq" in df.columns else "timestamp"
    once = df.groupBy(*by, "timestamp").agg(F.max_by(name, order).alias("equity"))
    unit = once.agg(F.max("timestamp").alias("largest"))
    return once.withColumn("largest", unit.scalar()).select(*by, scaled_epoch_micros(F.col("timestamp"), F.col("largest")).alias("ts_us"), "equity")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_tradelog(df: DataFrame) -> DataFrame:
    return require(df, "timestamp", "symbol", "type", "quantity", "price").select(*[F.col(f.name).cast(f.dataType) for f in TRADELOG if f.name in df.columns])


def discover_runs(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Strategy and symbol told by a file's name, as in tradelog_<strategy>_<symbol>.csv."""
    return df.withColumn("strategy", F.regexp_extract(name, r"^[a-z]+_([a-z]+)_", 1)).withColumn("run", F.regexp_extract(name, r"^[a-z]+_[a-z]+_([^.]+?)(?:_\d+)?\.", 1)).withColumn("kind", F.regexp_extract(name, r"\.([a-z]+)$", 1))


def dedupe_quotes(quotes: DataFrame) -> DataFrame:
    """Polled quotes: a repeat of the stamp before is dropped; the price is the mid, or the one side there is."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("seq")
    bid, ask = F.coalesce("bid", F.lit(0.0)), F.coalesce("ask", F.lit(0.0))
    price = F.when((bid > 0) & (ask > 0), (bid + ask) / 2).when(bid > 0, bid).when(ask > 0, ask)
    new = ~F.col("stamp").eqNullSafe(F.lag("stamp").over(w)) | (F.row_number().over(w) == 1)
    return quotes.withColumn("new", new).where("new").withColumn("price", price).where("price IS NOT NULL").drop("new")


def manifest(df: DataFrame, **facts: Column) -> DataFrame:
    """One row with a JSON document of the given aggregates."""
    return df.agg(F.to_json(F.struct(*[c.alias(n) for n, c in facts.items()])).alias("manifest"))


def topic_lines(df: DataFrame, topic: str, fields: list[str]) -> DataFrame:
    """Rows as published messages: a topic and a CSV payload."""
    return df.select(F.lit(topic).alias("topic"), F.concat_ws(",", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("payload"))


def subscribe(messages: DataFrame, topic: str, schema: str) -> DataFrame:
    """Messages of one topic as typed rows (batch or stream)."""
    return messages.where(F.col("topic") == topic).select(F.from_csv("payload", schema).alias("m")).select("m.*")


def head_subset(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in a stated order (a subset file for quick tests)."""
    return df.orderBy(order).limit(n)


def replay(df: DataFrame, batch: int = 1000, pause: float = 0.0) -> Iterator[pd.DataFrame]:
    """A bounded frame as consecutive batches in order of time, for one publishing process, ``pause`` seconds apart.

    The engine sorts by ranges, and partitions come to the publisher one after another: it holds one and the next.
    """
    held: list[tuple] = []
    for row in df.orderBy("ts", "seq").toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == batch:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
            time.sleep(pause)
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def bars_as_ticks(bars: DataFrame) -> DataFrame:
    """Minute bars as a tick feed: one tick per bar at its close."""
    return bars.select("symbol", F.col("bar_ts").alias("ts"), F.unix_micros("bar_ts").alias("seq"), F.col("close").alias("price"), F.col("close").alias("bid"), F.col("close").alias("ask"), *[F.col("volume").alias(c) for c in ("bid_size", "ask_size", "volume")])


def process_ticks(ticks: DataFrame, actions: DataFrame) -> DataFrame:
    """The ingestion job: ticks filled forward, as daily closes, adjusted for corporate actions."""
    from tickloom.operators.clean import back_adjust, forward_fill, valid_actions

    filled = forward_fill(ticks)
    at = F.struct("ts", "seq")
    daily = filled.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return back_adjust(daily, valid_actions(actions))


def write_equity(equity: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """One folder per curve where ``by`` names the curves."""
    equity.select(*by, "timestamp", "equity").write.partitionBy(*by).mode("overwrite").csv(path, header=True)


def write_tradelog(trades: DataFrame, path: str) -> None:
    trades.select(*[f.name for f in TRADELOG]).write.mode("overwrite").csv(path, header=True)
