"""Column expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n ﻿"


def code(c: str | Column) -> Column:
    """A symbol, id or status without regard to case and outer blanks; a blank one is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def num(c: str | Column) -> Column:
    """NaN becomes NULL; everything else is kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ (session zone UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a, b)
