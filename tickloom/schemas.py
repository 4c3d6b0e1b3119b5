"""Canonical schemas of market data; files are read with these, never with inferred ones."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _struct(spec: str) -> T.StructType:
    """A schema from "name kind, ..." that needs no running session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in spec.split(", "))])


TICK = _struct("symbol string, ts timestamp, seq bigint, price double, bid double, ask double, bid_size bigint, ask_size bigint, volume bigint")
BAR = _struct("symbol string, bar_ts timestamp, open double, high double, low double, close double, volume bigint")
PANEL = _struct("date date, symbol string, close double, volume double, ret double")
FILL = _struct("order_id string, symbol string, side string, qty bigint, price double, ts timestamp")
EQUITY = _struct("timestamp bigint, equity double")
TRADELOG = _struct("timestamp bigint, symbol string, type string, quantity bigint, price double, cash double")
WEIGHTS = _struct("symbol string, weight double")
ORDER_TYPES, SIDES = ("MARKET", "LIMIT", "IOC", "TARGET_PERCENT"), ("BUY", "SELL")
TIME_IN_FORCE, STATUSES = ("DAY", "IOC", "GTC"), ("PENDING", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED")
