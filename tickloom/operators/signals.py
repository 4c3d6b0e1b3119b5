"""Signals, position machines and the sizing of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import half_away, rows
from tickloom.functions.running import overlapping, running
from tickloom.operators.micro import CHUNK
from tickloom.operators.windows import moving_average


def crossover(bars: DataFrame, short: int, long: int, by: str = "symbol", order: str = "bar_s", guarded: bool = False) -> DataFrame:
    """Signal +1 where the short average rises over the long one, -1 where it falls below.

    An average is 0 until its window is full, so the first full bar may read as a fall; ``guarded`` asks for a
    long average on the bar before as well, which removes that reading.
    """
    w = Window.partitionBy(by).orderBy(order)
    out = bars.withColumn("sma_s", moving_average("close", by, order, short)).withColumn("sma_l", moving_average("close", by, order, long))
    ps, pl, s, l = F.lag("sma_s").over(w), F.lag("sma_l").over(w), F.col("sma_s"), F.col("sma_l")
    ready = (l > 0) & (pl > 0) if guarded else l > 0
    return out.withColumn("signal", F.when(ready & (ps <= pl if guarded else ps < pl) & (s > l), 1).when(ready & (ps >= pl if guarded else ps >= pl) & (s < l), -1).otherwise(0))


def long_flat(signals: DataFrame, by: str = "symbol", order: str = "bar_s") -> DataFrame:
    """Crossing events that flip a long-or-flat book: buys unless already long, sells only when long."""
    w = Window.partitionBy(by).orderBy(order)
    events = signals.where("signal <> 0").withColumn("before", F.coalesce(F.lag("signal").over(w), F.lit(-1)))
    return events.where("signal <> before").drop("before")


def align_pairs(a: DataFrame, b: DataFrame, hedge: float = 1.0, order: str = "bar_s") -> DataFrame:
    """Bars of two legs at the same instant with their spread."""
    return a.select(order, F.col("close").alias("close_a")).join(b.select(order, F.col("close").alias("close_b")), order).withColumn("spread", F.col("close_a") - hedge * F.col("close_b"))


def pairs_machine(z: DataFrame, entry: float, leave: float, by: str = "pair", order: str = "bar_s") -> DataFrame:
    """Position of a pair: -1 above the entry level, +1 below its mirror, 0 within the exit level, else held.

    A flat pair enters only; one in position leaves only. Between two exits the first entry decides, so the
    position is that of the first entry after the last exit: two running windows, no fold.
    """
    w = rows(by, order)
    out = z.withColumn("mark", F.when(F.abs("z") < leave, 0).when(F.col("z") > entry, -1).when(F.col("z") < -entry, 1))
    out = out.withColumn("run", F.coalesce(F.sum(F.when(F.col("mark") == 0, 1).otherwise(0)).over(w), F.lit(0)))
    inside = Window.partitionBy(by, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("mark") != 0, F.col("mark")), ignorenulls=True).over(inside)
    return out.withColumn("pos", F.coalesce(F.when(F.col("mark") == 0, 0).otherwise(first), F.lit(0))).drop("run")


def pair_quantities(positions: DataFrame, hedge: float, lot: int = 100) -> DataFrame:
    """Shares of both legs; the hedge leg is cut to whole shares."""
    return positions.withColumn("qty_a", F.col("pos") * lot).withColumn("qty_b", -F.col("pos") * F.lit(int(lot * hedge)))


def first_tick_orders(ticks: DataFrame, qty: int = 100, by: str = "symbol") -> DataFrame:
    """One market buy at each symbol's first tick."""
    first = ticks.groupBy(by).agg(F.min_by(F.struct("ts", "seq", "price"), F.struct("ts", "seq")).alias("t"))
    return first.select(by, F.col("t.seq").alias("seq"), F.lit("BUY").alias("side"), F.lit(qty).alias("qty"), F.col("t.price").alias("price"))


def event_counts(ticks: DataFrame, bars: DataFrame, by: str = "symbol") -> DataFrame:
    return ticks.groupBy(by).agg(F.count("*").alias("ticks")).join(bars.groupBy(by).agg(F.count("*").alias("bars")), by, "full")


def delta_orders(weights: DataFrame, holdings: DataFrame, prices: DataFrame, cash: float, min_dollar: float) -> DataFrame:
    """Orders (symbol, side, qty) that move holdings to the target weights.

    NAV is cash plus priced holdings; a NAV of 0 gives no orders, changes below ``min_dollar`` and symbols without
    a positive price none either. Quantities are whole shares, rounded down.
    """
    book = weights.join(holdings, "symbol", "full").join(prices.where("price > 0"), "symbol").select("symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("position", F.lit(0)).alias("position"), "price")
    nav = book.agg((F.lit(cash) + F.coalesce(F.sum(F.col("position") * F.col("price")), F.lit(0.0))).alias("nav"))
    out = book.withColumn("nav", nav.scalar()).where("nav <> 0").withColumn("dollars", F.col("weight") * F.col("nav") - F.col("position") * F.col("price"))
    out = out.where(F.abs("dollars") >= min_dollar).withColumn("qty", F.floor(F.abs(F.col("dollars") / F.col("price"))))
    return out.where("qty > 0").select("symbol", F.when(F.col("dollars") > 0, "BUY").otherwise("SELL").alias("side"), "qty")


def first_of_day(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each day (one rebalance a day)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by, F.to_date("ts").alias("day")).agg(F.min_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select(*by, "day", *[F.col(f"r.{c}") for c in rest])


def at_time_of_day(df: DataFrame, hour: int, minute: int, slack: int = 1) -> DataFrame:
    """Rows within ``slack`` minutes of a time of day, in the same hour."""
    return df.where((F.hour("ts") == hour) & (F.abs(F.minute("ts") - minute) <= slack))


def target_deltas(weights: DataFrame, holdings: DataFrame, prices: DataFrame, nav: float, lot: int = 1, largest: float = 1e9) -> DataFrame:
    """Shares to trade, in whole lots (halves away from zero); missing or non-positive prices, targets beyond
    ``largest`` and changes of 0 are left out."""
    met = weights.join(prices.where("price > 0"), "symbol").join(holdings, "symbol", "left")
    target = F.col("weight") * nav / F.col("price")
    out = met.withColumn("target", target).where(F.abs("target") <= largest)
    out = out.withColumn("delta", (half_away((F.col("target") - F.coalesce("position", F.lit(0))) / lot) * lot).cast("bigint"))
    return out.where("delta <> 0").select("symbol", "delta")


def build_orders(deltas: DataFrame, min_qty: int = 0, kind: str = "MARKET") -> DataFrame:
    return deltas.where(F.abs("delta") > min_qty).select("symbol", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("qty"), F.lit(kind).alias("order_type"))


def submit_status(orders: DataFrame) -> DataFrame:
    """Each order's own outcome: one bad order spoils no other."""
    bad = F.col("symbol").isNull() | (F.col("qty") <= 0) | ~F.col("side").isin("BUY", "SELL") | (F.col("order_type") == "TARGET_PERCENT")
    return orders.withColumn("status", F.when(F.coalesce(bad, F.lit(True)), "REJECTED").otherwise("PENDING"))


def positions(fills: DataFrame, by: str = "symbol") -> DataFrame:
    """Net quantity per symbol, flat ones left out."""
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    return fills.groupBy(by).agg(F.sum(signed).alias("position")).where("position <> 0")


def rebalance_trades(weights: DataFrame, prices: DataFrame, notional: float, by: str = "symbol", order: str = "date") -> DataFrame:
    """Trades of a book held at whole-share targets of a fixed notional; on days without a book it is held.

    A symbol absent from a day's book has target 0; the trade is the change of target under full fills.
    """
    days = weights.select(order).distinct().withColumn("booked", F.lit(True))
    met = prices.join(days, order).join(weights, [order, by], "left")
    target = half_away(F.coalesce("weight", F.lit(0.0)) * notional / F.col("close"))
    out = met.withColumn("target", target.cast("bigint"))
    return out.withColumn("trade", F.col("target") - F.lag("target", 1, 0).over(Window.partitionBy(by).orderBy(order))).select(order, by, "target", "trade")


def toxic(vpin: Column, ofi: Column, side: Column, threshold: float) -> Column:
    """Whether to rest an order instead of crossing: flow is toxic and against it. Unknown VPIN crosses."""
    return F.coalesce((vpin > threshold) & ~F.isnan(vpin) & F.when(side == "BUY", ofi < 0).otherwise(ofi > 0), F.lit(False))


def scheduled_orders(ticks: DataFrame, every: int, ahead: int, half_spread: float, threshold: float, by: str = "symbol") -> DataFrame:
    """An order every ``every`` ticks once VPIN is known, sides in turn, filled blindly or through the gate.

    Ticks are those of ``toxicity``, numbered by n_; chunks of them overlap by ``ahead`` rows, so that a hot key spreads.
    A rested order fills passively if one of the next ``ahead`` prices reaches the near side, else it crosses at the
    tick ``ahead`` later. Columns blind_slip and filtered_slip are the costs against the arrival mid.
    """
    c = overlapping(ticks, "n_", max(CHUNK, 2 * ahead), ahead=ahead)
    w = Window.partitionBy(by, "chunk_").orderBy("n_")
    nxt = w.rowsBetween(1, ahead)
    t = c.select("*", F.min("price").over(nxt).alias("lo_"), F.max("price").over(nxt).alias("hi_"), F.lead("price", ahead).over(w).alias("then_"), ((F.col("bid") + F.col("ask")) / 2).alias("mid")).where("own_").drop("chunk_", "own_")
    t = running(t.where("vpin IS NOT NULL AND then_ IS NOT NULL"), [by], ["n_"], F.floor(F.col("n_") / CHUNK), sums={"i": F.lit(1)}).where((F.col("i") - 1) % every == 0)
    t = t.withColumn("side", F.when(F.floor((F.col("i") - 1) / every) % 2 == 0, "BUY").otherwise("SELL"))
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    rest = toxic(F.col("vpin"), F.col("ofi"), F.col("side"), threshold)
    passive = F.when(F.col("side") == "BUY", F.col("lo_") <= F.col("mid") - half_spread).otherwise(F.col("hi_") >= F.col("mid") + half_spread)
    late = sign * (F.col("then_") - F.col("mid")) + half_spread
    return t.withColumn("rested", rest).withColumn("filled_passive", rest & passive).withColumn("blind_slip", F.lit(half_spread)).withColumn("filtered_slip", F.when(~rest, F.lit(half_spread)).when(passive, F.lit(-half_spread)).otherwise(late)).drop("lo_", "hi_", "then_", "n_")


def reconcile_fills(fills: DataFrame, venue: DataFrame) -> DataFrame:
    """Per venue order: local fills, venue fills, and whether they agree."""
    local = fills.groupBy("order_id").agg(F.sum("qty").alias("local_qty"))
    return venue.join(local, "order_id", "left").withColumn("local_qty", F.coalesce("local_qty", F.lit(0))).withColumn("matched", F.col("local_qty") == F.coalesce("filled_qty", F.lit(0)))


# A venue's order states and ours.
VENUE_STATUS = {"new": "PENDING", "accepted": "PENDING", "pending_new": "PENDING", "partially_filled": "PARTIALLY_FILLED", "filled": "FILLED", "canceled": "CANCELLED", "cancelled": "CANCELLED", "expired": "CANCELLED", "rejected": "REJECTED"}


def venue_status(status: Column) -> Column:
    out = F.lit("PENDING")
    for theirs, ours in VENUE_STATUS.items():
        out = F.when(F.lower(status) == theirs, ours).otherwise(out)
    return out


def fill_increments(reports: DataFrame, by: str = "order_id", order: str = "seq") -> DataFrame:
    """New fills from cumulative reports: the growth of filled_qty, no row where nothing was filled."""
    w = Window.partitionBy(by).orderBy(order)
    return reports.withColumn("fill", F.col("filled_qty") - F.lag("filled_qty", 1, 0).over(w)).where("fill > 0")
