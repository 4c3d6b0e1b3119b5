"""User strategies: plans over whole tables where signals are relational, callbacks where they are not, and their backtest."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple, Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.fold import fold_sorted
from tickloom.operators.book import book_of
from tickloom.operators.signals import crossover, long_flat


class SignalStrategy(Protocol):
    """A strategy as a plan: bars in, (symbol, bar_s, signal, close) out, with +1 to buy and -1 to sell. The way to prefer."""

    def signals(self, bars: DataFrame) -> DataFrame: ...


@dataclass
class SmaCrossover:
    """Long while the short average is above the long one, flat otherwise."""

    short: int
    long: int
    guarded: bool = True

    def signals(self, bars: DataFrame) -> DataFrame:
        return long_flat(crossover(bars, self.short, self.long, guarded=self.guarded))


class Bar(NamedTuple):
    symbol: str
    bar_s: int
    open: float
    high: float
    low: float
    close: float
    volume: int


class Fill(NamedTuple):
    symbol: str
    order_id: str
    side: str
    qty: int
    price: float


class Broker:
    """What a strategy with callbacks trades through; orders meet the book after the callback returns."""

    def __init__(self) -> None:
        self.asked: list[tuple] = []
        self.made = 0

    def _ask(self, action: str, symbol: str, oid: str, side: str | None, kind: str | None, qty: int | None, limit: float | None) -> str:
        self.asked.append((action, symbol, oid, side, kind, qty, limit))
        return oid

    def market(self, symbol: str, side: str, qty: int) -> str:
        self.made += 1
        return self._ask("order", symbol, f"{symbol}-{self.made}", side, "MARKET", qty, None)

    def limit(self, symbol: str, side: str, qty: int, price: float, immediate: bool = False) -> str:
        self.made += 1
        return self._ask("order", symbol, f"{symbol}-{self.made}", side, "IOC" if immediate else "LIMIT", qty, price)

    def cancel(self, symbol: str, order_id: str) -> None:
        self._ask("cancel", symbol, order_id, None, None, None, None)

    def replace(self, symbol: str, order_id: str, qty: int, price: float) -> None:
        self._ask("replace", symbol, order_id, None, None, qty, price)


class Strategy:
    """A strategy with callbacks, for what no plan expresses. Each does nothing unless overridden; state is the object's own.

    It must be picklable: one is made per key, on the executors.
    """

    def __init__(self) -> None:
        self.broker = Broker()

    def on_tick(self, tick: Any) -> None:
        """Every tick, before anything else happens with it."""

    def on_bar(self, bar: Bar) -> None:
        """Every bar, once a tick of another interval closes it, or at the end."""

    def on_fill(self, fill: Fill) -> None:
        """Every fill of the strategy's orders."""


class CallbackCrossover(Strategy):
    """The guarded crossover with callbacks: buys unless long, sells what it holds."""

    def __init__(self, short: int = 5, long: int = 20, qty: int = 100) -> None:
        super().__init__()
        self.short, self.long, self.qty = short, long, qty
        self.closes: dict[str, deque] = {}
        self.before: dict[str, tuple[float, float]] = {}
        self.held: dict[str, bool] = {}

    def on_bar(self, bar: Bar) -> None:
        c = self.closes.setdefault(bar.symbol, deque(maxlen=self.long))
        c.append(bar.close)
        mean = lambda n: sum(list(c)[-n:]) / n if len(c) >= n else 0.0
        (ps, pl), (s, l) = self.before.get(bar.symbol, (0.0, 0.0)), (mean(self.short), mean(self.long))
        self.before[bar.symbol] = s, l
        if not (l > 0 and pl > 0):
            return
        if ps <= pl and s > l and not self.held.get(bar.symbol):
            self.held[bar.symbol] = True
            self.broker.market(bar.symbol, "BUY", self.qty)
        elif ps >= pl and s < l and self.held.get(bar.symbol):
            self.held[bar.symbol] = False
            self.broker.market(bar.symbol, "SELL", self.qty)


EVENT = "key string, symbol string, seq bigint, kind string, order_id string, side string, qty bigint, price double, bar_s bigint, open double, high double, low double, close double, volume bigint, note string"


class _Run:
    """One key's run: its strategy, and per symbol the open bar and the book."""

    def __init__(self, make: Callable[[], Strategy], seconds: int, model: str) -> None:
        self.make, self.seconds, self.model = make, seconds, model
        self.strategy, self.open, self.books, self.sides, self.failed, self.last = make(), {}, {}, {}, False, (None, None)

    def _event(self, symbol: str, kind: str, **values: Any) -> tuple:
        names = ("order_id", "side", "qty", "price", "bar_s", "open", "high", "low", "close", "volume", "note")
        return (self.last[0], symbol, self.last[1], kind, *[values.get(n) for n in names])

    def _call(self, f: Callable[[Any], None], x: Any, out: list[tuple]) -> None:
        """A callback; one that raises ends the key's trading, is reported, and leaves bars to be flushed."""
        if self.failed:
            return
        try:
            f(x)
        except Exception as error:  # noqa: BLE001  whatever a user's code raises
            self.failed = True
            out.append(self._event(getattr(x, "symbol", None), "error", note=f"{type(error).__name__}: {error}"))

    def _orders(self, out: list[tuple]) -> None:
        asked, self.strategy.broker.asked = self.strategy.broker.asked, []
        for action, symbol, oid, side, kind, qty, limit in asked:
            book = self.books.setdefault(symbol, book_of(self.model))
            if action == "order":
                self.sides[oid] = side
                book.submit(self.last[1], oid, side, kind, qty, limit)
                out.append(self._event(symbol, "order", order_id=oid, side=side, qty=qty, price=limit, note=kind))
            else:
                done = book.cancel(oid) if action == "cancel" else book.replace(self.last[1], oid, qty, limit)
                out.append(self._event(symbol, action, order_id=oid, qty=qty, price=limit, note="done" if done else "refused"))

    def _fills(self, out: list[tuple]) -> None:
        for symbol, book in self.books.items():
            done, book.fills = book.fills, []
            for oid, _, n, price, role in done:
                if oid in self.sides:
                    out.append(self._event(symbol, "fill", order_id=oid, side=self.sides[oid], qty=n, price=price, note=role))
                    self._call(self.strategy.on_fill, Fill(symbol, oid, self.sides[oid], n, price), out)

    def _bar(self, symbol: str, out: list[tuple]) -> None:
        bar = Bar(symbol, *self.open.pop(symbol))
        out.append(self._event(symbol, "bar", **{n: v for n, v in bar._asdict().items() if n != "symbol"}))
        self._call(self.strategy.on_bar, bar, out)

    def row(self, t: Any) -> list[tuple]:
        if self.failed:
            return []
        out: list[tuple] = []
        self.last = t.key, t.seq
        self._call(self.strategy.on_tick, t, out)
        start = int(t.second) // self.seconds * self.seconds
        bar = self.open.get(t.symbol)
        if bar is not None and bar[0] == start:
            bar[2], bar[3], bar[4], bar[5] = max(bar[2], t.price), min(bar[3], t.price), t.price, bar[5] + int(t.volume)
        else:
            if bar is not None:
                self._bar(t.symbol, out)
            self.open[t.symbol] = [start, t.price, t.price, t.price, t.price, int(t.volume)]
        self._orders(out)
        if not self.failed:
            book = self.books.setdefault(t.symbol, book_of(self.model))
            book.tick(t.seq, t.price, int(t.volume), (t.bid, t.ask, int(t.bid_size), int(t.ask_size)), lambda: (self._fills(out), self._orders(out)))
            self._fills(out)
            self._orders(out)
        return out

    def end(self) -> list[tuple]:
        out: list[tuple] = []
        for symbol in list(self.open):
            self._bar(symbol, out)
        return out


def backtest(ticks: DataFrame, make: Callable[[], Strategy], seconds: int, model: str = "top_of_book", by: str = "symbol") -> DataFrame:
    """All that happens in a run: (key, symbol, seq, kind bar|order|cancel|replace|fill|error, ...).

    ticks: (symbol, seq, ts, price, volume, bid, ask, bid_size, ask_size), run in order of (ts, seq). Per tick come on_tick, the bar
    it closes and on_bar, the book with first and second matching pass, and on_fill after each. ``by`` names
    what shares one strategy: a symbol, or an account that trades several. A callback that raises ends its key's
    run with a row of kind error; open bars are flushed in any case. Ticks lacking a price, quote or size are left out.
    """
    sizes = ["price", "volume", "bid", "ask", "bid_size", "ask_size"]
    t = ticks.dropna(subset=["symbol", "seq", "ts", *sizes]).select(F.col(by).cast("string").alias("key"), "symbol", F.col("seq").cast("bigint").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *sizes)
    t = t.withColumn("second", F.floor(F.col("at") / 1_000_000))
    return fold_sorted(t, "key", ["at", "seq"], lambda: _Run(make, seconds, model), EVENT)


def signal_orders(strategy: SignalStrategy, bars: DataFrame, qty: int) -> DataFrame:
    """A plan's signals as market orders (symbol, bar_s, side, qty, close)."""
    s = strategy.signals(bars)
    return s.select("symbol", "bar_s", F.when(F.col("signal") > 0, "BUY").otherwise("SELL").alias("side"), F.lit(qty).cast("bigint").alias("qty"), "close")


def positions(events: DataFrame) -> DataFrame:
    """Running position of every key and symbol after each of its fills."""
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    w = Window.partitionBy("key", "symbol").orderBy("seq", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.where("kind = 'fill'").withColumn("position", F.sum(signed).over(w))
