"""Limit-order books: closed forms for one-sided questions, and a fold for the full state."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.fold import fold_sorted
from tickloom.functions.running import day_of, running

SPAN = 1_000_000  # sequence numbers of one bucket of a running value


def top_of_book(quotes: DataFrame, by: str = "symbol") -> DataFrame:
    """The latest quote per symbol with mid and spread."""
    q = quotes.groupBy(by).agg(F.max_by(F.struct("bid", "ask", "bid_size", "ask_size"), F.struct("ts", "seq")).alias("q")).select(by, "q.*")
    return q.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.col("ask") - F.col("bid"))


def consume_displayed(orders: DataFrame, by: tuple[str, ...] = ("symbol", "epoch"), order: str = "seq") -> DataFrame:
    """Fills against the size displayed by one quote: each order gets what those before it leave.

    ``epoch`` numbers the quote in force; columns qty and size (displayed).
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("qty").over(w), F.lit(0))
    return orders.withColumn("filled", F.least(F.col("qty"), F.greatest(F.lit(0), F.col("size") - before)))


def levels(resting: DataFrame) -> DataFrame:
    return resting.groupBy("symbol", "side", "price").agg(F.sum("size").alias("size"), F.count("*").alias("orders"))


def _best_first(side: Column, price: Column) -> Column:
    """Sort key: asks cheapest first, bids dearest first."""
    return F.when(side == "BUY", -price).otherwise(price)


def top_levels(resting: DataFrame, n: int) -> DataFrame:
    """The n best levels of each side, level 1 the best."""
    w = Window.partitionBy("symbol", "side").orderBy(_best_first(F.col("side"), F.col("price")))
    return levels(resting).withColumn("level", F.row_number().over(w)).where(F.col("level") <= n)


def queue_positions(resting: DataFrame) -> DataFrame:
    """Place of every order in the queue of its level, from 1; a lower priority stands before."""
    return resting.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "side", "price").orderBy("priority", "seq")))


def without_cancelled(resting: DataFrame, cancels: DataFrame) -> DataFrame:
    return resting.join(cancels.select("order_id").distinct(), "order_id", "left_anti")


def consume_level(resting: DataFrame, quantity: Column) -> DataFrame:
    """First-in-first-out fills at one level: ``taken`` of each order when ``quantity`` trades there."""
    w = Window.partitionBy("symbol", "side", "price").orderBy("priority", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return resting.withColumn("taken", F.least(F.col("size"), F.greatest(F.lit(0), quantity - F.coalesce(F.sum("size").over(w), F.lit(0)))))


def walk(depth: DataFrame, request: list[str], quantity: str = "qty", order: str = "level") -> DataFrame:
    """Market orders walking a ladder: (request, filled, vwap). Best level first; too little depth fills in part.

    depth has one row per request and level (price, size); quantities that are not positive fill 0 at 0.
    """
    w = Window.partitionBy(*request).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    took = depth.withColumn("taken", F.least(F.col("size"), F.greatest(F.lit(0), F.col(quantity) - F.coalesce(F.sum("size").over(w), F.lit(0)))))
    return took.groupBy(*request).agg(F.sum("taken").alias("filled"), F.coalesce(F.try_divide(F.sum(F.col("taken") * F.col("price")), F.sum("taken")), F.lit(0.0)).alias("vwap"))


def ladder(quotes: DataFrame, depth: int, grid: float, size: Column, touch: Column | None = None) -> DataFrame:
    """Synthetic depth behind a quote: level 0 at the touch, then one level per grid step."""
    out = quotes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    return out.withColumn("price", F.when(F.col("side") == "BUY", F.col("ask") + F.col("level") * grid).otherwise(F.col("bid") - F.col("level") * grid)).withColumn("size", F.when(F.col("level") == 0, touch if touch is not None else size).otherwise(size))


def naive_fills(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """Fills without a book: from its submission on each tick's volume fills an order at the mid, volume being
    shared with no one. orders: (order_id, symbol, submit_seq, qty). One row per fill.

    Cumulative volume turns it into an equi-join on the symbol and a range on cumulative volume: an order is
    done within the ticks whose running volume lies between that at its submission and qty more. The running
    volume at submission is looked up by the union of both streams, so no order meets all of a symbol's ticks.
    """
    t = ticks.select("symbol", "seq", F.lit(1).alias("is_order"), "volume", "mid", F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("bigint").alias("qty"))
    o = orders.select("symbol", F.col("submit_seq").alias("seq"), F.lit(0).alias("is_order"), F.lit(0).cast("bigint").alias("volume"), F.lit(None).cast("double").alias("mid"), "order_id", F.col("qty").cast("bigint").alias("qty"))
    s = running(t.unionByName(o), ["symbol"], ["seq", "is_order"], F.floor(F.col("seq") / SPAN), sums={"cum": F.col("volume")})
    # volume is cut into bins; an order joins only the bins its fills can lie in
    bin_ = 1024
    left = s.where("is_order = 0").select("symbol", "order_id", "qty", F.col("cum").alias("from")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / bin_), F.floor((F.col("from") + F.col("qty")) / bin_))))
    right = s.where("is_order = 1 AND volume > 0").select("symbol", "seq", "mid", F.col("cum").alias("hi"), (F.col("cum") - F.col("volume")).alias("lo")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_), F.floor(F.col("hi") / bin_))))
    met = left.join(right, ["symbol", "bin"]).where("hi > from AND lo < from + qty AND bin = greatest(floor(lo / 1024), floor(from / 1024))")
    fill = F.least(F.col("hi"), F.col("from") + F.col("qty")) - F.greatest(F.col("lo"), F.col("from"))
    return met.select("order_id", "symbol", "seq", fill.alias("fill"), F.col("mid").alias("price"))


def order_summary(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Filled quantity, average price and status of each order."""
    f = fills.groupBy("order_id").agg(F.sum("fill").alias("filled"), (F.sum(F.col("fill") * F.col("price")) / F.sum("fill")).alias("avg_price"))
    met = orders.join(f, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return met.withColumn("status", F.when(F.col("filled") >= F.col("qty"), "FILLED").when(F.col("filled") > 0, "PARTIALLY_FILLED").otherwise("PENDING"))


def with_slippage(price: Column, coefficient: Column, qty: Column, side: Column) -> Column:
    """Linear impact for fills whose price has none of its own."""
    c = F.coalesce(coefficient, F.lit(0.0))
    return price + F.when(side == "BUY", 1.0).otherwise(-1.0) * price * c * qty


def ledger(fills: DataFrame, cash: float, by: str = "symbol", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Running cash and position of a key, without a cash check."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    out = running(fills, [by], list(order), day_of(order[0]), sums={"position": sign * F.col("qty"), "spent": sign * F.col("qty") * F.col("price")})
    return out.withColumn("cash", F.lit(cash) - F.col("spent")).drop("spent")


def guarded_ledger(fills: DataFrame, cash: float, by: str = "account") -> DataFrame:
    """Per account, trades in order: a buy that costs more than the cash left changes nothing.

    Each decision rests on all before it, so an account is one ordered fold, streamed in batches with the cash left as its
    state. Returns (by, seq, accepted, cash).
    """

    class Account:
        def __init__(self) -> None:
            self.left = cash

        def row(self, r: Any) -> list[tuple]:
            cost = r.qty * r.price
            done = r.side != "BUY" or cost <= self.left
            if done:
                self.left += -cost if r.side == "BUY" else cost
            return [(r.key, r.seq, done, self.left)]

        def end(self) -> list[tuple]:
            return []

    rows_ = fills.select(F.col(by).alias("key"), "ts", "seq", "side", "qty", "price")
    return fold_sorted(rows_, "key", ["ts", "seq"], Account, f"key {fills.schema[by].dataType.simpleString()}, seq bigint, accepted boolean, cash double").withColumnRenamed("key", by)


def equity_curve(fills: DataFrame, ticks: DataFrame, cash: float) -> DataFrame:
    """Cash plus positions at last prices, per tick of a symbol (a symbol is its own sub-account).

    Fills and ticks run in one ordered stream; a fill at a tick's instant comes before it.
    """
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    f = fills.select("symbol", "seq", F.lit(0).alias("k"), (sign * F.col("qty")).alias("dq"), (-sign * F.col("qty") * F.col("price")).alias("dc"), F.lit(None).cast("double").alias("px"))
    t = ticks.select("symbol", "seq", F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("dq"), F.lit(0.0).alias("dc"), F.col("price").alias("px"))
    both = f.withColumn("dq", F.col("dq").cast("bigint")).unionByName(t)
    run = running(both, ["symbol"], ["seq", "k"], F.floor(F.col("seq") / SPAN), sums={"q": F.col("dq"), "c": F.col("dc")})
    return run.where("k = 1").select("symbol", "seq", (F.lit(cash) + F.col("c") + F.col("q") * F.col("px")).alias("equity"))


def portfolio_equity(fills: DataFrame, ticks: DataFrame, cash: float) -> DataFrame:
    """(symbol, seq, equity): one row per tick, the whole portfolio valued at the last price seen of every symbol.

    Positions of symbols without a price yet count nothing; a fill at a tick's instant comes before it. Each event
    changes the equity by what its own symbol alone tells (a tick by position times price change, a fill by quantity
    times last price less its cost), so the symbols are walked side by side and the changes summed along ``seq``.
    """
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    f = fills.select("symbol", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("k"), (sign * F.col("qty")).cast("bigint").alias("dq"), F.col("price").cast("double").alias("paid"), F.lit(None).cast("double").alias("px"))
    t = ticks.select("symbol", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("dq"), F.lit(0.0).alias("paid"), F.col("price").cast("double").alias("px"))
    place = F.floor(F.col("seq") / SPAN)
    own = running(f.unionByName(t), ["symbol"], ["seq", "k"], place, sums={"q": F.col("dq")}, lasts={"last": F.col("px")})
    prior = running(own, ["symbol"], ["seq", "k"], place, before={"was": F.col("last")})
    was = F.coalesce("was", F.lit(0.0))
    change = F.when(F.col("k") == 1, F.when(F.col("px").isNotNull(), F.col("q") * (F.col("px") - was)).otherwise(0.0)).otherwise(F.col("dq") * (was - F.col("paid")))
    line = running(prior.select("symbol", "seq", "k", change.alias("change")), [], ["seq", "k", "symbol"], place, sums={"sum": F.col("change")})
    return line.where("k = 1").select("symbol", "seq", (F.lit(cash) + F.col("sum")).alias("equity"))


class Book:
    """One symbol's full-depth book with first-in-first-out queues, plus tracked orders of our own."""

    def __init__(self) -> None:
        self.queues, self.ours, self.live = {"BUY": {}, "SELL": {}}, {}, []
        self.touch, self.fills = {}, []

    def rest(self, side: str, price: float, oid: str, size: int, front: bool = False) -> int:
        q = self.queues[side].setdefault(price, deque())
        if any(o[0] == oid for o in q):
            return 0
        (q.appendleft if front else q.append)([oid, size])
        return 1 if front else len(q)

    def remove(self, side: str, price: float, oid: str) -> int:
        q = self.queues[side].get(price, deque())
        hit = next((o for o in q if o[0] == oid), None)
        if hit is None:
            return 0
        q.remove(hit)
        if not q:
            del self.queues[side][price]
        return hit[1]

    def best(self, side: str) -> float | None:
        prices = self.queues[side]
        return (max if side == "BUY" else min)(prices) if prices else None

    def take(self, side: str, price: float, qty: int) -> list[tuple[str, int]]:
        """FIFO consumption at a level; the head keeps its place while part of it is left."""
        out, q = [], self.queues[side].get(price, deque())
        while q and qty > 0:
            n = min(q[0][1], qty)
            out.append((q[0][0], n))
            q[0][1] -= n
            qty -= n
            if not q[0][1]:
                q.popleft()
        if price in self.queues[side] and not q:
            del self.queues[side][price]
        return out

    def sweep(self, side: str, qty: int, limit: float | None = None) -> list[tuple[str, int, float]]:
        """A buyer (or seller) walking the other side up to its limit."""
        other, out = ("SELL" if side == "BUY" else "BUY"), []
        while qty > 0 and (p := self.best(other)) is not None and (limit is None or (p <= limit if side == "BUY" else p >= limit)):
            for oid, n in self.take(other, p, qty):
                out.append((oid, n, p))
                qty -= n
        return out

    def quote(self, bid: float, ask: float, bid_size: int, ask_size: int) -> None:
        """The displayed quote replaces the one before and stands first in its queues."""
        for side, price, size in (("BUY", bid, bid_size), ("SELL", ask, ask_size)):
            if side in self.touch:
                self.remove(side, self.touch[side], "quote")
            if size > 0:
                self.rest(side, price, "quote", size, front=True)
                self.touch[side] = price

    def credit(self, seq: int, taken: list[tuple[str, int]], price: float) -> None:
        for oid, n in taken:
            if oid in self.ours:
                self.ours[oid]["left"] -= n
                self.fills.append((oid, seq, n, price, "maker"))

    def submit(self, seq: int, oid: str, side: str, kind: str, qty: int, limit: float | None) -> None:
        self.ours[oid] = {"side": side, "kind": kind, "left": qty, "limit": limit}
        if kind == "LIMIT":
            self._cross(seq, oid)
            if self.ours[oid]["left"] > 0:
                self.rest(side, limit, oid, self.ours[oid]["left"])
        else:
            self.live.append(oid)

    def cancel(self, oid: str) -> bool:
        o = self.ours.get(oid)
        if not o or o["left"] <= 0:
            return False
        if o["kind"] == "LIMIT":
            self.remove(o["side"], o["limit"], oid)
        o["left"] = 0
        self.live = [x for x in self.live if x != oid]
        return True

    def _cross(self, seq: int, oid: str) -> None:
        o = self.ours[oid]
        for other, n, p in self.sweep(o["side"], o["left"], o["limit"] if o["kind"] != "MARKET" else None):
            o["left"] -= n
            self.fills.append((oid, seq, n, p, "taker"))
            self.credit(seq, [(other, n)], p)

    def replace(self, seq: int, oid: str, qty: int, limit: float) -> bool:
        """Cancel and submit anew, at the end of the queue; only a working limit order can be replaced."""
        o = self.ours.get(oid)
        if not o or o["kind"] != "LIMIT" or not self.cancel(oid):
            return False
        self.submit(seq, oid, o["side"], "LIMIT", qty, limit)
        return True

    def attempt(self, seq: int) -> None:
        """What is live and not resting walks the book as it stands."""
        for oid in list(self.live):
            self._cross(seq, oid)
            if self.ours[oid]["left"] <= 0:
                self.live.remove(oid)

    def tick(self, seq: int, price: float, volume: int, quote: tuple[float, float, int, int], between: Callable[[], object] | None = None) -> None:
        """Print, then quote, then matching, then what is immediate-or-cancel goes; then a second pass over what is left."""
        side = "SELL" if price in self.queues["SELL"] else "BUY"
        self.credit(seq, self.take(side, price, volume), price)
        self.quote(*quote)
        self.attempt(seq)
        self.live = [x for x in self.live if self.ours[x]["kind"] != "IOC"]
        if between:
            between()
        self.attempt(seq)


class TouchBook:
    """Matching without depth: at the touch with a shared displayed size, or naively at the mid.

    top_of_book: market and immediate orders take what the touch displays, limit orders do when it crosses them; what
    one takes is gone for the next until a new quote. naive: every order fills against each tick's volume by itself,
    market orders at the mid and limit orders at their limit once crossed. No quote, no fill.
    """

    def __init__(self, model: str) -> None:
        self.model, self.live, self.fills = model, {}, []
        self.shown, self.touch = {"BUY": 0, "SELL": 0}, None

    def submit(self, seq: int, oid: str, side: str, kind: str, qty: int, limit: float | None) -> None:
        self.live[oid] = [side, kind, qty, limit]

    def cancel(self, oid: str) -> bool:
        return self.live.pop(oid, None) is not None

    def replace(self, seq: int, oid: str, qty: int, limit: float) -> bool:
        o = self.live.get(oid)
        if not o or o[1] != "LIMIT":
            return False
        self.cancel(oid)
        self.submit(seq, oid, o[0], "LIMIT", qty, limit)
        return True

    def attempt(self, seq: int, volume: int) -> None:
        if self.touch is None:
            return
        bid, ask = self.touch
        for oid, o in list(self.live.items()):
            side, kind, left, limit = o
            touch = ask if side == "BUY" else bid
            crosses = kind == "MARKET" or limit is not None and (touch <= limit if side == "BUY" else touch >= limit)
            n = min(left, volume if self.model == "naive" else self.shown[side]) if crosses else 0
            if n > 0:
                at = touch if self.model != "naive" else (bid + ask) / 2 if kind == "MARKET" else limit
                self.fills.append((oid, seq, n, at, "taker"))
                o[2] -= n
                self.shown[side] -= n
            if o[2] <= 0:
                del self.live[oid]

    def tick(self, seq: int, price: float, volume: int, quote: tuple[float, float, int, int], between: Callable[[], object] | None = None) -> None:
        """Quote, then matching, then what is immediate-or-cancel goes; with a book a second pass over what is left."""
        bid, ask, bid_size, ask_size = quote
        self.shown, self.touch = {"BUY": ask_size, "SELL": bid_size}, (bid, ask)
        self.attempt(seq, volume)
        for oid in [x for x, o in self.live.items() if o[1] == "IOC"]:
            del self.live[oid]
        if between:
            between()
        if self.model != "naive":
            self.attempt(seq, volume)


def book_of(model: str) -> Book | TouchBook:
    return Book() if model == "full_depth" else TouchBook(model)


FILL = "symbol string, order_id string, seq bigint, qty bigint, price double, role string"


class Replay:
    """One symbol's book under a stream of ticks, orders, cancels and replaces."""

    def __init__(self, model: str) -> None:
        self.book = book_of(model)

    def row(self, e: Any) -> list[tuple]:
        if e.kind == "tick":
            self.book.tick(e.seq, e.price, int(e.volume), (e.bid, e.ask, int(e.bid_size), int(e.ask_size)))
        elif e.kind == "order":
            self.book.submit(e.seq, e.order_id, e.side, e.order_type, int(e.qty), e.limit_price)
        elif e.kind == "replace":
            self.book.replace(e.seq, e.order_id, int(e.qty), e.limit_price)
        else:
            self.book.cancel(e.order_id)
        done, self.book.fills = self.book.fills, []
        return [(e.symbol, *f) for f in done]

    def end(self) -> list[tuple]:
        return []


def replay_book(events: DataFrame, model: str = "full_depth") -> DataFrame:
    """Fills (symbol, order_id, seq, qty, price, role) of orders meeting a stream of ticks, per symbol.

    events: (symbol, seq, kind tick|order|cancel|replace, order_id, side, order_type, qty, limit_price, price, volume, bid,
    ask, bid_size, ask_size). Queue priority makes each event depend on all before it, so a symbol is one ordered fold,
    streamed in batches with the book as its state; symbols run side by side.
    """
    return fold_sorted(events, "symbol", ["seq"], lambda: Replay(model), FILL)


def impact_curve(mids: DataFrame, sizes: list[int], depth: int, half_spread: float, grid: float, base: int) -> DataFrame:
    """Slippage of buys of given sizes on synthetic ladders behind each mid: (profile, sample, mid, qty, filled, vwap, bps).

    Profiles: uniform (equal levels) and linear (levels growing with distance). Level sizes are arithmetic series, so the
    number of whole levels a buy takes has a closed form, and its cost is a sum over those levels within the row.
    """
    rows_ = mids.withColumn("profile", F.explode(F.array(F.lit("uniform"), F.lit("linear")))).withColumn("qty", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])))
    linear = F.col("profile") == "linear"
    taken = lambda k: (F.lit(base) * F.when(linear, k * (k + 1) / 2).otherwise(k)).cast("bigint")  # noqa: E731  by k whole levels
    r = rows_.withColumn("filled", F.greatest(F.least(F.col("qty"), taken(F.lit(depth))), F.lit(0)).cast("bigint"))
    root = F.floor((F.sqrt(1 + 8 * F.col("filled") / base) - 1) / 2)
    root = F.when(taken(root + 1) <= F.col("filled"), root + 1).when(taken(root) > F.col("filled"), root - 1).otherwise(root)  # rounding of the root
    r = r.withColumn("k", F.when(linear, root).otherwise(F.floor(F.col("filled") / base)).cast("int"))
    price = lambda j: F.col("mid") + half_spread + j * grid
    whole = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0.0), lambda acc, j: acc + F.when(j < F.col("k"), F.lit(base) * F.when(linear, j + 1).otherwise(1)).otherwise(F.col("filled") - taken(F.col("k"))) * price(j))
    r = r.withColumn("vwap", F.when(F.col("filled") > 0, whole / F.col("filled")).otherwise(0.0))
    touch = F.col("mid") + half_spread
    return r.withColumn("bps", (F.col("vwap") - touch) / touch * 1e4).select("profile", "sample", "mid", "qty", "filled", "vwap", "bps")


def power_law(curve: DataFrame, by: str = "profile", least: int = 1600) -> DataFrame:
    """log-log fit of mean slippage on size: exponent, coefficient, R2."""
    m = curve.groupBy(by, "qty").agg(F.avg("bps").alias("bps")).where((F.col("bps") > 1e-6) & (F.col("qty") >= least))
    y, x = F.log("bps"), F.log("qty")
    return m.groupBy(by).agg(F.regr_slope(y, x).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("coefficient"), F.regr_r2(y, x).alias("r2"))


def phantom_pnl(naive: DataFrame, depth: DataFrame, keys: list[str]) -> DataFrame:
    """Profit that exists only in the naive fills."""
    return naive.join(depth, keys).withColumn("phantom", F.col("naive_pnl") - F.col("depth_pnl"))
