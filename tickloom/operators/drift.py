"""Schemas that drift between files: minimum-cost edit scripts, a change report and one consistent table."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = frozenset({"", "na", "null", "-"})
SEPARATORS = (",", ";", "|", "\t")
INTEGER = re.compile(r"[+-]?\d+\Z", re.ASCII)
DECIMAL = re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+)\Z", re.ASCII)

# The fields of the consistent table and names that usually carry them.
FIELDS = {
    "timestamp": ("timestamp", "ts", "time", "epoch", "datetime", "date_time", "event_time"),
    "symbol": ("symbol", "sym", "ticker", "asset_code", "asset", "instrument", "security", "code"),
    "type": ("type", "side", "action", "direction", "buy_sell", "trade_type"),
    "quantity": ("quantity", "qty", "shares", "size", "volume", "units", "amount"),
    "price": ("price", "px", "fill_price", "trade_price", "exec_price", "rate"),
    "cash": ("cash", "cash_after", "cash_balance", "balance", "acct_cash", "account_cash"),
    "commission": ("commission", "comm", "fee", "fees", "broker_fee", "commissions", "charge"),
    "venue": ("venue", "mic", "exchange", "market"),
    "strategy": ("strategy", "strat"),
    "order_ref": ("order_ref", "order_id", "orderref", "ref", "ord"),
}


def fold(name: str) -> str:
    """A column name without case, camel humps and punctuation."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


FIELD_OF = {fold(n): f for f, names in FIELDS.items() for n in names}


def clean(name: str) -> str:
    return name.strip(" \t\r\n﻿").strip('"').strip("'").strip(" \t\r\n﻿")


def separator_of(header: str) -> str:
    bare = re.sub(r'"[^"]*"', "", header)
    return max(SEPARATORS, key=bare.count)


def split_line(line: str, sep: str) -> list[str]:
    return [x.strip() for x in next(csv.reader([line.rstrip("\r\n")], delimiter=sep, skipinitialspace=True), [])]


def flat(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """Leaves of a nested object as (dotted path, text as written)."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, f"{path}.{clean(k)}" if path else clean(k))
    elif isinstance(value, list):
        yield path, json.dumps(value)
    else:
        yield path, "" if value is None else str(value).strip()


class LineParser:
    """Cells of lines, with each header read once; ``header`` is a file's header line, or None for JSON lines."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, list[str]]] = {}

    def cells(self, line: str, header: str | None) -> tuple[list[str], list[str]]:
        """Names and texts of one line; a broken JSON line has none, a short line only its first columns."""
        if header is None:
            try:
                got = list(flat(json.loads(line.strip(" \r\n\ufeff"), parse_int=str, parse_float=str, parse_constant=str)))
            except ValueError:
                return [], []
            return [n for n, _ in got], [v for _, v in got]
        if header not in self.known:
            sep = separator_of(header)
            self.known[header] = sep, [clean(x) for x in split_line(header.lstrip("\ufeff"), sep)]
        sep, names = self.known[header]
        values = split_line(line, sep) if '"' in line else [x.strip() for x in line.rstrip("\r\n").split(sep)]
        n = min(len(names), len(values))
        return names[:n], values[:n]


def kind_of(text: str) -> str | None:
    if text.strip().lower() in MISSING:
        return None
    return "integer" if INTEGER.match(text) else "decimal" if DECIMAL.match(text) else "text"


NUMBER = re.compile(r"[^\d+\-.,]{0,4}([+-]?[\d][\d.,]*|[+-]?[.,]\d+)[^\d.,]{0,12}\Z", re.ASCII)


def plain_number(text: str) -> float | None:
    """The number a text writes, with units, currency signs, thousands separators and decimal commas read away."""
    m = NUMBER.match(text.strip().replace("\u00a0", "").replace(" ", ""))
    if not m:
        return None
    digits = m.group(1)
    dot, comma = digits.rfind("."), digits.rfind(",")
    if comma >= 0 and dot >= 0:
        point = "." if dot > comma else ","
    elif comma >= 0:
        point = "" if digits.count(",") > 1 or re.fullmatch(r"[+-]?[1-9]\d{0,2},\d{3}", digits) else ","
    else:
        point = "" if digits.count(".") > 1 else "."
    other = {".": ",", ",": ".", "": ".,"}[point]
    digits = "".join("." if c == point else c for c in digits if c not in other or c == point)
    try:
        return float(digits)
    except ValueError:
        return None


@lru_cache(maxsize=4096)
def quantity_of(text: str) -> object:
    """What a value says, whatever its writing: a number, an instant in seconds, or upper-case text; None if missing."""
    t = text.strip()
    if t.lower() in MISSING:
        return None
    if (n := plain_number(t)) is not None:
        return n
    if re.match(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", t):
        try:
            stamp = pd.Timestamp(t)
            return (stamp.tz_convert("UTC").tz_localize(None) if stamp.tzinfo else stamp).value / 1e9
        except (ValueError, OverflowError):
            pass
    return t.upper()


@dataclass
class Schema:
    """A file's schema: its leaf columns in order, their types, and the values of its border rows."""

    columns: list[str]
    kinds: dict[str, str | None]
    first: list[dict[str, str]] = field(default_factory=list)
    last: list[dict[str, str]] = field(default_factory=list)


SCALES = (1.0, 100.0, 0.01, 1000.0, 0.001, 1e6, 1e-6)  # cents, milliseconds and the like


def compared(a: str, b: str, old: Schema, new: Schema) -> tuple[float | None, float]:
    """(agreement, scale) of column b with column a over the rows both files hold.

    The agreement is the share of those rows in which b says what a said, None if all are missing; numbers may be
    rewritten by one scale, which then has to explain all rows.
    """
    told: list[float] = []
    scales = set()
    for x, y in border(old, new):
        u, v = quantity_of(x.get(a, "")), quantity_of(y.get(b, ""))
        if u is None and v is None:
            continue
        if isinstance(u, float) and isinstance(v, float):
            fits = next((k for k in SCALES if abs(u * k - v) <= 1e-6 * max(abs(u * k), abs(v)) or u * k == v), 0.0)
            if u or v:  # zeros fit any scale
                scales.add(fits)
            told.append(float(fits > 0))
        elif isinstance(u, str) and isinstance(v, str):
            told.append(float(u == v or u[0] == v[0] and min(len(u), len(v)) == 1))
        else:
            told.append(0.0)
    if len(scales) > 1:
        return (0.0 if len(scales - {0.0}) > 1 else sum(told) / len(told)), 1.0
    return (sum(told) / len(told) if told else None), (scales.pop() or 1.0) if scales else 1.0


def evidence(a: str, b: str, old: Schema, new: Schema) -> float | None:
    return compared(a, b, old, new)[0]


def border(old: Schema, new: Schema) -> list[tuple[dict[str, str], dict[str, str]]]:
    """The rows with which a file repeats the end of the one before, as pairs."""
    n = min(len(old.last), len(new.first))
    return list(zip(old.last[len(old.last) - n :], new.first[:n])) if n else []


REMOVE_ADD = 2.0  # a leaf removed and another added


def relabel_cost(a: str, b: str, old: Schema, new: Schema) -> float:
    """Cost of turning column a into b, between 0 (the same) and 2 (no cheaper than remove and add).

    The values of the rows both files hold overrule the names, equal ones too; without such rows names decide.
    """
    fa, fb = FIELD_OF.get(fold(a.rpartition(".")[2])), FIELD_OF.get(fold(b.rpartition(".")[2]))
    same_name = fold(a) == fold(b) or (fa is not None and fa == fb)
    seen = evidence(a, b, old, new)
    if a == b:
        return 0.0 if seen is None or seen >= 0.5 else 1.6
    if seen is None:  # nothing but the names can tell
        return 0.5 if same_name else REMOVE_ADD
    if same_name:
        return 0.3 if seen >= 0.5 else 1.2
    if fa is not None and fb is not None and fa != fb:  # two names known to mean different things
        return REMOVE_ADD if seen < 1 else 1.5
    return 0.4 + 1.6 * (1 - seen)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment (Hungarian method with potentials) of a rectangular matrix."""
    if not cost.size:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row, delta, nxt = match[j], np.inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    cur = c[row - 1, k - 1] - u[row] - v[k]
                    if cur < low[k]:
                        low[k], way[k] = cur, j
                    if low[k] < delta:
                        delta, nxt = low[k], k
            for k in range(m + 1):
                if used[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                else:
                    low[k] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(match[k] - 1, k - 1) for k in range(1, m + 1) if match[k]]
    return [(b, a) for a, b in pairs] if turned else pairs


@dataclass
class Node:
    """A node of a schema tree: an object with its members, or a column (a leaf)."""

    path: str
    leaf: bool
    kids: list[Node] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def tree_of(columns: list[str]) -> Node:
    """The tree whose leaves are the columns, dotted paths being members of objects."""
    root, inner = Node("", False), {}
    for c in dict.fromkeys(columns):
        above = root
        parts = c.split(".")
        for i in range(1, len(parts)):
            path = ".".join(parts[:i])
            if path not in inner:
                inner[path] = Node(path, False)
                above.kids.append(inner[path])
            above = inner[path]
        above.kids.append(Node(c, True))
    return root


class TreeEdit:
    """Constrained edit distance of unordered trees (Zhang), with its script.

    Inserting or deleting a node costs 1, relabelling a leaf what relabel_cost says, an object 0 or 1. Disjoint
    subtrees stay disjoint, so the children of two nodes meet in a minimum-cost assignment.
    """

    def __init__(self, old: Schema, new: Schema) -> None:
        self.old, self.new, self.known = old, new, {}

    def relabel(self, a: Node, b: Node) -> float:
        if a.leaf != b.leaf:
            return float("inf")
        if a.leaf:
            return min(relabel_cost(a.path, b.path, self.old, self.new), REMOVE_ADD)
        return 0.0 if a.name == b.name else 1.0

    def trees(self, a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
        """Least cost of turning one subtree into another, and the pairs of nodes that correspond."""
        key = (id(a), id(b))
        if key not in self.known:
            cost, pairs = self.forests(a, b)
            ways = [(cost + self.relabel(a, b), [(a, b), *pairs])]
            for kid in b.kids:  # b stands over what a became
                if not kid.leaf or a.leaf:
                    cost, pairs = self.trees(a, kid)
                    ways.append((b.size() - kid.size() + cost, pairs))
            for kid in a.kids:  # a is taken off what became b
                if not kid.leaf or b.leaf:
                    cost, pairs = self.trees(kid, b)
                    ways.append((a.size() - kid.size() + cost, pairs))
            self.known[key] = min(ways, key=lambda w: w[0])
        return self.known[key]

    def forests(self, a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
        """The same for the members of two nodes."""
        m, n = len(a.kids), len(b.kids)
        off = np.array([float(k.size()) for k in a.kids]), np.array([float(k.size()) for k in b.kids])
        met = np.array([[self.trees(x, y)[0] for y in b.kids] for x in a.kids]).reshape(m, n)
        # square: a node may also meet nothing
        both = off[0][:, None] + off[1][None, :]
        gain = np.minimum(met - both, 0.0)
        pairs = [(i, j) for i, j in assign(gain) if gain[i, j] < 0]
        ways = [(off[0].sum() + off[1].sum() + sum(gain[i, j] for i, j in pairs), [p for i, j in pairs for p in self.trees(a.kids[i], b.kids[j])[1]])]
        for kid in b.kids:  # an object put around all members
            if not kid.leaf and m:
                cost, inner = self.forests(a, kid)
                ways.append((b.size() - 1 - (kid.size() - 1) + cost, inner))
        for kid in a.kids:  # or taken off
            if not kid.leaf and n:
                cost, inner = self.forests(kid, b)
                ways.append((a.size() - 1 - (kid.size() - 1) + cost, inner))
        return min(ways, key=lambda w: w[0])


def edit_script(old: Schema, new: Schema) -> list[tuple[str, str | None, str | None]]:
    """Minimum-cost script (operation, old path, new path) between two schema trees.

    The constrained tree edit distance pairs the nodes; columns it deletes in one place and inserts in another, of equal
    quantity, are moves. Operations on columns: keep (by name and parent, whatever the parent is called), rename, move,
    remove, add; on objects: rename_node.
    """
    left, right = tree_of(old.columns), tree_of(new.columns)
    pairs = TreeEdit(old, new).trees(left, right)[1]
    above = {b.path: a.path for a, b in pairs if not b.leaf}
    script: list[tuple[str, str | None, str | None]] = []
    for a, b in pairs:
        if not b.leaf:
            if a.name != b.name:
                script.append(("rename_node", a.path, b.path))
            continue
        same_parent = above.get(b.path.rpartition(".")[0]) == a.path.rpartition(".")[0]
        script.append(("move" if not same_parent else "keep" if a.name == b.name else "rename", a.path, b.path))
    paired = {a for op, a, _ in script if op != "rename_node"}, {b for op, _, b in script if op != "rename_node"}
    rest = [c for c in dict.fromkeys(old.columns) if c not in paired[0]], [c for c in dict.fromkeys(new.columns) if c not in paired[1]]
    cost = np.minimum(np.array([[relabel_cost(x, y, old, new) for y in rest[1]] for x in rest[0]]).reshape(len(rest[0]), len(rest[1])), REMOVE_ADD)
    moved = [(rest[0][i], rest[1][j]) for i, j in assign(cost) if cost[i, j] < REMOVE_ADD]
    script += [("move" if a.rpartition(".")[0] != b.rpartition(".")[0] else "rename", a, b) for a, b in moved]
    gone, come = {a for a, _ in moved}, {b for _, b in moved}
    return script + [("remove", c, None) for c in rest[0] if c not in gone] + [("add", None, c) for c in rest[1] if c not in come]


def changes(old: Schema, new: Schema) -> list[tuple[str, str]]:
    """(column as written, change) of a file against the one before it in its stream."""
    out = []
    for op, a, b in edit_script(old, new):
        if op == "remove":
            out.append((a, "removed"))
        elif op == "add":
            out.append((b, "added"))
        else:
            if op != "keep":
                out.append((b, "moved" if op == "move" else "renamed"))
            if old.kinds.get(a) and new.kinds.get(b) and old.kinds[a] != new.kinds[b]:
                out.append((b, "retyped"))
    return out


# ---------------------------------------------------------------- Spark side

CELLS = "array<struct<name:string,value:string>>"


def data_lines(lines: DataFrame, salts: int = 8) -> DataFrame:
    """Every data line with its file's header: (stream, file_no, file_name, line_no, line, header), NULL for JSON lines.

    A file's header line is found first and joined to its lines under salted keys, so that one file holding a
    large share of all lines is spread. Blank and NULL lines, and lines without stream or file_no, are left out.
    """
    base = lines.where(F.col("stream").isNotNull() & F.col("file_no").isNotNull() & F.col("line").isNotNull() & (F.btrim("line", F.lit(" \t\r\n\ufeff")) != ""))
    base = base.select("stream", "file_no", "file_name", "line_no", "line")
    is_json = F.btrim("line", F.lit(" \t\r\n\ufeff")).startswith("{")
    head = base.where(~is_json).groupBy("stream", "file_no").agg(F.min(F.struct("line_no", "line")).alias("h")).where(F.col("h.line_no").isNotNull())
    head = head.select("stream", "file_no", F.col("h.line_no").alias("header_no"), F.col("h.line").alias("header")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = base.withColumn("json", is_json).withColumn("salt", F.when(is_json, F.lit(-1)).otherwise(F.pmod(F.coalesce("line_no", F.lit(0)), F.lit(salts))))
    met = salted.join(head, ["stream", "file_no", "salt"], "left")
    data = met.where(F.col("json") | (F.coalesce("line_no", F.lit(0)) != F.col("header_no")) & (F.col("line") != F.col("header")))
    return data.select("stream", "file_no", "file_name", "line_no", "line", F.when(~F.col("json"), F.col("header")).alias("header"))


def with_cells(data: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of data lines, and their cells; broken JSON lines give none, repeated lines are kept."""
    kind = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = LineParser()
        for batch in batches:
            names, values, ends = [], [], [0]
            for line, header in zip(batch.column("line").to_pylist(), batch.column("header").to_pylist()):
                n, v = parser.cells(line, header)
                names += n
                values += v
                ends.append(len(names))
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], cells], [*keep, "cells"])

    return data.mapInArrow(run, f"{kind}, cells {CELLS}")


def file_schemas(data: DataFrame, border_rows: int = 3) -> DataFrame:
    """One row per file: columns with their place and types, and its first and last distinct rows.

    Types are told by partial aggregation over the cells; of the lines themselves only the text is shuffled, once, to
    find the distinct ones, and only border rows are then taken apart again.
    """
    f = ["stream", "file_no"]
    value = F.btrim("value")
    empty = F.lower(value).isin(*MISSING)
    typed = with_cells(data, [*f, "file_name", "line", "header"]).select(*f, "file_name", F.posexplode("cells").alias("place", "cell")).select(*f, "file_name", "place", F.col("cell.name").alias("name"), F.col("cell.value").alias("value"))
    kind = F.when(empty | F.col("value").isNull(), None).when(value.rlike(r"^[+-]?[0-9]+$"), 0).when(value.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), 1).otherwise(2)
    columns = typed.groupBy(*f, "name").agg(F.max("file_name").alias("file_name"), F.min("place").alias("place"), F.max(kind).alias("kind"))
    columns = columns.groupBy(*f).agg(F.max("file_name").alias("file_name"), F.sort_array(F.collect_list(F.struct("place", "name", "kind"))).alias("columns"))
    once = data.groupBy(*f, "line").agg(F.min("line_no").alias("line_no"), F.max("header").alias("header"))
    at = lambda order: F.row_number().over(Window.partitionBy(*f).orderBy(order))  # noqa: E731  a rank limit: pruned before the shuffle
    ends = [once.withColumn("i", at(order)).where(F.col("i") <= border_rows).withColumn("end", F.lit(name)).drop("i") for order, name in ((F.asc("line_no"), "first"), (F.desc("line_no"), "last"))]
    border = with_cells(ends[0].unionByName(ends[1]), [*f, "line_no", "end"]).groupBy(*f).agg(*[F.sort_array(F.collect_list(F.when(F.col("end") == n, F.struct("line_no", "cells")))).alias(n) for n in ("first", "last")])
    return columns.join(border, f, "left")


def _schema(columns, first, last) -> Schema:
    names = ("integer", "decimal", "text")
    rows = lambda x: [{c["name"]: c["value"] or "" for c in r["cells"]} for r in (x if x is not None else [])]
    return Schema([c["name"] for c in columns], {c["name"]: None if c["kind"] is None else names[c["kind"]] for c in columns}, rows(first), rows(last))


def schema_scripts(schemas: DataFrame) -> DataFrame:
    """(stream, file_no, file_name, op, old, new, old_kind, new_kind, scale): the edit script of each file against the one before."""
    w = Window.partitionBy("stream").orderBy("file_no")
    paired = schemas.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in ("columns", "first", "last")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                new = _schema(r.columns, r.first, r.last)
                if r.old_columns is None:
                    script, old = [("start", None, c) for c in new.columns], Schema([], {})
                else:
                    old = _schema(r.old_columns, r.old_first, r.old_last)
                    script = edit_script(old, new)
                scale = lambda a, b: compared(a, b, old, new)[1] if a is not None and b is not None else 1.0  # noqa: B023, E731
                out += [(r.stream, r.file_no, r.file_name, op, a, b, old.kinds.get(a), new.kinds.get(b), scale(a, b)) for op, a, b in script]
            yield pd.DataFrame(out, columns=["stream", "file_no", "file_name", "op", "old", "new", "old_kind", "new_kind", "scale"])

    return paired.drop("order").mapInPandas(compare, "stream string, file_no int, file_name string, op string, old string, new string, old_kind string, new_kind string, scale double")


def drift_report(lines: DataFrame, written: bool = False) -> DataFrame:
    """(file_name, column_name, change): added, removed, renamed, moved or retyped, file against file before.

    A renamed object is one change, under its own path; its members keep theirs. With ``written`` only columns count, as
    written: whatever changes the name of a column, be it a new parent, is renamed.
    """
    s = schema_scripts(file_schemas(data_lines(lines)))
    if written:
        renamed = F.col("op").isin("keep", "rename", "move") & (F.col("old") != F.col("new"))
        moved = F.lit(None).cast("string")
    else:
        renamed = F.col("op").isin("rename", "rename_node")
        moved = F.when(F.col("op") == "move", F.lit("moved"))
    change = F.array_compact(F.array(
        F.when(F.col("op") == "remove", F.lit("removed")).when(F.col("op") == "add", F.lit("added")).when(renamed, F.lit("renamed")).otherwise(moved),
        F.when(F.col("op").isin("keep", "rename", "move") & (F.col("old_kind") != F.col("new_kind")), F.lit("retyped")),
    ))
    return s.where("op <> 'start'").select("file_name", F.coalesce("new", "old").alias("column_name"), F.explode(change).alias("change"))


def projections(scripts: DataFrame) -> DataFrame:
    """Scripts compiled along each stream into (stream, file_no, mapping): column as written to field.

    A column keeps the field its forerunner had; a new one takes the field its name usually carries, if free,
    and else its own folded name. A stream's scripts hold one row per column and file.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], {}
        for no, rows in pdf.sort_values("file_no").groupby("file_no", sort=True):
            now = {r.new: (held[r.old][0], held[r.old][1] * r.scale) for r in rows.itertuples() if r.new is not None and r.old in held}
            for r in rows.itertuples():
                if r.new is not None and r.new not in now:
                    guess = FIELD_OF.get(fold(r.new.rpartition(".")[2]), r.new.lower())
                    now[r.new] = (guess if guess not in {f for f, _ in now.values()} else r.new.lower(), 1.0)
            held = now
            out.append((pdf["stream"].iloc[0], no, [{"name": k, "value": f, "scale": c} for k, (f, c) in now.items()]))
        return pd.DataFrame(out, columns=["stream", "file_no", "mapping"])

    return scripts.where("op <> 'rename_node'").groupBy("stream").applyInPandas(follow, "stream string, file_no int, mapping array<struct<name:string,value:string,scale:double>>")


def number_in(text: Column) -> Column:
    """The number a text writes: units and signs dropped, thousands separators and decimal commas read."""
    d = F.regexp_extract(text, r"([+-]?(?:[0-9][0-9.,]*|[.,][0-9]+))", 1)
    bare, european = F.regexp_replace(d, ",", ""), F.replace(F.regexp_replace(d, r"\.", ""), F.lit(","), F.lit("."))
    plain = F.when(d.rlike(r"^[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$"), bare).when(d.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$|^[+-]?[0-9]{1,3}(\.[0-9]{3}){2,}$|^[+-]?[0-9]*,[0-9]+$"), european).otherwise(bare)
    return plain.try_cast("double")


def consistent_table(lines: DataFrame, salts: int = 8) -> DataFrame:
    """All files as one table: the named fields typed, any others in a map, one row per data line.

    Values that do not parse are NULL in the typed field. Lines keep their file and place.
    """
    data = data_lines(lines)
    parsed = with_cells(data, ["stream", "file_no", "file_name", "line_no"])
    plan = projections(schema_scripts(file_schemas(data))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = parsed.withColumn("salt", F.pmod(F.coalesce("line_no", F.lit(0)), F.lit(salts))).join(plan, ["stream", "file_no", "salt"])
    name_of = F.map_from_entries(F.transform("mapping", lambda x: F.struct(x["name"], x["value"])))
    scale_of = F.map_from_entries(F.transform("mapping", lambda x: F.struct(x["value"], x["scale"])))
    uniq = F.aggregate("cells", F.expr(f"CAST(array() AS {CELLS})"), lambda acc, x: F.when(F.exists(acc, lambda y: y["name"] == x["name"]), acc).otherwise(F.concat(acc, F.array(x))))
    value = F.map_from_entries(F.transform(F.filter(uniq, lambda x: F.element_at(name_of, x["name"]).isNotNull()), lambda x: F.struct(F.element_at(name_of, x["name"]), F.when(~F.lower(F.btrim(x["value"])).isin(*MISSING), x["value"]))))
    row = met.select("stream", "file_no", "file_name", "line_no", value.alias("v"), scale_of.alias("c"))
    text = lambda n: F.element_at("v", n)
    number = lambda n: number_in(text(n)) / F.coalesce(F.element_at("c", n), F.lit(1.0))
    stamp = F.when(text("timestamp").rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_micros((F.when(text("timestamp").cast("double") > 1e11, text("timestamp").cast("double") * 1000).otherwise(text("timestamp").cast("double") * 1000000)).cast("bigint")))
    stamp = F.coalesce(stamp, F.try_to_timestamp(text("timestamp")))
    core = ["timestamp", "symbol", "type", "quantity", "price", "cash", "commission"]
    return row.select(
        "stream", "file_no", "file_name", "line_no", stamp.alias("timestamp"), F.upper(F.btrim(text("symbol"))).alias("symbol"), F.upper(F.btrim(text("type"))).alias("type"),
        F.rint(number("quantity")).cast("bigint").alias("quantity"),
        *[number(c).alias(c) for c in core[4:]],
        F.to_json(F.map_filter("v", lambda k, v: ~k.isin(*core) & v.isNotNull())).alias("others"),
    )
