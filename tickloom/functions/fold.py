"""Ordered folds: where each row rests on all before it, a key's rows pass one after another through a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tickloom.functions.spread import spread


class Folder(Protocol):
    """The state of one key."""

    def row(self, r: Any) -> Iterable[tuple]:
        """Rows that come out of the next row of the key, a named tuple of the input's columns."""

    def end(self) -> Iterable[tuple]:
        """Rows that come out after the key's last row."""


def fold_sorted(df: DataFrame, by: str, order: list[str], make: Callable[[], Folder], schema: str) -> DataFrame:
    """Rows of each key in order through a Folder; keys run side by side.

    Keys are sorted within their partition by the engine, which spills, and reach Python in batches: a task holds the
    state of one key and one batch, however many rows the key has. Rows without a key are folded like any other key.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    place = df.columns.index(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                k = r[place]
                if state is None or (k != key and not (k is None and key is None)):
                    if state is not None:
                        out.extend(state.end())
                    key, state = k, make()
                out.extend(state.row(r))
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(list(state.end()), columns=names)

    return spread(df, by).sortWithinPartitions(by, *order).mapInPandas(run, schema)
