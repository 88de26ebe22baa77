"""Exact order statistics by refined histograms: no row is sorted, shuffled or gathered.

:func:`select` finds the rows at given places of one or more orders of a frame. A cell is a
range of one order's keys that holds a wanted place; at first it is the whole frame.

1. Each pass splits every open cell into equal widths of its current key, between the least
   and greatest value that the rows in it have, and counts the rows of the parts: a partial
   aggregate over the frame, at most ``CELLS`` parts an order, whatever the input. All orders share
   the pass.
2. The parts that hold wanted places are the next cells. A part with one value goes on
   with the next key of the order, so a value that a third of the rows have costs no more than
   any other.
3. Cells of at most ``LEAF`` rows, and only the rows in them, come to the driver, which
   holds ``LEAF`` rows a place at most.

:func:`ntiles` turns the rows where buckets begin into a projection (a row is compared with
the beginnings in its own part of the whole frame, which a literal lists) and :func:`add_rank` cuts the frame into cells of known
beginnings, so that its windows are bounded and a hot value needs none.

The order of keys is Spark's, nulls last in ascending and descending orders alike. Keys are
integers, decimals, dates, strings or booleans; doubles are ordered by their bits
(a vectorised function, used for them alone).
"""

from __future__ import annotations

import datetime
import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.ranking import _bucket_rows

#: Parts per order and pass.
CELLS = 4096
#: Rows of a cell that are read as they are.
LEAF = 256
MIN_CELLS = 4

Order = tuple[tuple[str, bool], ...]
_KEYS = (T.IntegralType, T.DecimalType, T.DateType, T.StringType, T.BooleanType)


@dataclass(frozen=True)
class Hit:
    """The key at a place, the rows before the first row with that key, the rows that have it,
    and the part of the whole frame that it lies in."""

    key: tuple
    before: int
    equal: int
    part: int


@dataclass
class _Cell:
    order: int
    at: int                    # index of the current key
    fixed: tuple               # values of the keys before it
    low: object                # least and greatest value of the current key; None: it has nulls only
    high: object
    nulls: bool                # rows with a null in the current key belong to it
    before: int
    rows: int
    places: list[int] = field(default_factory=list)
    part: int | None = None    # part of the whole frame that it lies in; None: the whole frame


# Expressions over keys are SQL texts: they are long, and a text is one call to the JVM.

def _distance(x: str, low: str, same: str, of: T.DataType) -> str:
    """How far a value lies above ``low``, as a double that never falls where the value rises.

    ``same``: bytes that all strings of the cell have in common at their beginning.
    """
    if isinstance(of, T.BooleanType):
        return f"cast(cast({x} AS int) - cast({low} AS int) AS double)"
    if isinstance(of, T.DateType):
        return f"cast(datediff({x}, {low}) AS double)"
    if isinstance(of, T.DecimalType):
        return f"cast({x} - {low} AS double)"
    if isinstance(of, T.StringType):
        def number(t):
            return (f"cast(conv(rpad(hex(substring(cast({t} AS binary), {same} + 1, 6)), 12, '0'), 16, 10)"
                    " AS double)")
        return f"({number(x)} - {number(low)})"
    return f"cast(cast({x} AS decimal(20,0)) - cast({low} AS decimal(20,0)) AS double)"


def _part(x: str, low: str, high: str, same: str, of: T.DataType, asc: bool, parts: int) -> str:
    """Number of the part between ``low`` and ``high`` that a value lies in, in the order's
    direction; nulls lie in a part behind the others."""
    span = f"nullif({_distance(high, low, same, of)}, 0D)"
    split = f"cast(least(floor({_distance(x, low, same, of)} * {float(parts)}D / {span}), {parts - 1}) AS int)"
    # strings that differ behind the bytes looked at: the least value, and the rest
    part = f"CASE WHEN {span} IS NULL THEN cast({x} <> {low} AS int) ELSE {split} END"
    return f"CASE WHEN {x} IS NULL THEN {parts} ELSE {part if asc else f'{parts - 1} - ({part})'} END"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _common(low, high) -> int:
    if not isinstance(low, str):
        return 0
    a, b = low.encode(), high.encode()
    return next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def _json(value) -> str:
    if isinstance(value, Decimal):
        return format(value, "f")
    return json.dumps(value.isoformat() if isinstance(value, datetime.date) else value)


def _object(fields: dict) -> str:
    return "{" + ", ".join(f'"{k}": {_json(v)}' for k, v in fields.items()) + "}"


class _Passes:
    def __init__(self, df: DataFrame, orders: list[Order], cells: int):
        self.df, self.orders, self.cells = df, orders, cells
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.columns = list(dict.fromkeys(c for o in orders for c, _ in o))
        self.figures = [F.count(F.lit(1)).alias("n")] + [
            f(c).alias(f"{k}{i}") for i, c in enumerate(self.columns)
            for k, f in (("lo", F.min), ("hi", F.max), ("has", F.count))]
        whole = df.agg(*self.figures).first()
        self.total = whole["n"]
        self.roots = [self.cell(o, 0, (), whole, 0, True, [], None) for o in range(len(orders))]

    def cell(self, order: int, at: int, fixed: tuple, row, before: int, nulls: bool, places, part) -> _Cell:
        """The cell of counted rows, moved on over keys of which it has one value only."""
        keys, n = self.orders[order], row["n"]
        while at < len(keys):
            i = self.columns.index(keys[at][0])
            low, high, has = row[f"lo{i}"], row[f"hi{i}"], row[f"has{i}"]
            if has and (low != high or has < n and nulls):
                return _Cell(order, at, fixed, low, high, nulls and has < n, before, n, places, part)
            fixed, at, nulls = (*fixed, low if has else None), at + 1, True
        return _Cell(order, at, fixed, None, None, False, before, n, places, part)

    def literals(self, order: int, rows: list[tuple[int, dict]], extra: str) -> Column:
        """A literal: the ends of the whole frame, and for every part of it the given structs
        (fields by key and ``extra``)."""
        by_part: list[list[str]] = [[] for _ in range(self.cells + 1)]
        for part, fields in rows:
            by_part[part].append(_object(fields))
        root, keys = self.roots[order], self.orders[order]
        ends = {}
        if root.at < len(keys):
            if not isinstance(self.types[keys[root.at][0]], _KEYS):
                raise TypeError(f"no selection over {self.types[keys[root.at][0]].simpleString()} keys")
            ends = {f"lo{root.at}": root.low, f"hi{root.at}": root.high}
        kinds = [self.types[name].simpleString() for name, _ in keys]
        own = ", ".join(f"lo{k}: {t}, hi{k}: {t}" for k, t in enumerate(kinds))
        fields = ", ".join([extra] + [f"v{k}: {t}, lo{k}: {t}, hi{k}: {t}" for k, t in enumerate(kinds)])
        text = "{" + '"root": ' + _object(ends) + ', "parts": [' + ", ".join(
            "[" + ", ".join(p) + "]" for p in by_part) + "]}"
        return F.from_json(F.lit(text), f"struct<root: struct<{own}>, parts: array<array<struct<{fields}>>>>",
                           {"mode": "FAILFAST"})

    def root_part(self, order: int, literals: str) -> str:
        """Part of the whole frame that a row lies in, by the order's first key with several values."""
        root = self.roots[order]
        if root.at == len(self.orders[order]):
            return "0"
        name, asc = self.orders[order][root.at]
        return _part(_name(name), f"{literals}.root.lo{root.at}", f"{literals}.root.hi{root.at}",
                     str(_common(root.low, root.high)), self.types[name], asc, self.cells)

    def spread(self, cells: list[_Cell], value: Callable[[int], str]) -> DataFrame:
        """One row ``_p`` (``value`` of an order, for a cell ``c``) per row and order that has it
        in one of the cells."""
        rows, found = self.df.select(*[_name(c) for c in self.columns]), []
        for o in sorted({c.order for c in cells}):
            keys, entries = self.orders[o], []
            for i, c in enumerate(cells):
                if c.order == o and c.part is not None:
                    fixed = {f"v{k}": v for k, v in enumerate(c.fixed) if v is not None}
                    ends = {f"lo{c.at}": c.low, f"hi{c.at}": c.high} if c.at < len(keys) else {}
                    entries.append((c.part, {"i": i, "at": c.at, "nulls": c.nulls,
                                             "same": _common(c.low, c.high), **fixed, **ends}))
            t = f"_t{o}"
            rows = rows.withColumn(t, self.literals(o, entries, "i: int, at: int, nulls: boolean, same: int"))
            if not entries:  # the first pass: the whole frame is one cell
                i = next(i for i, c in enumerate(cells) if c.order == o)
                found.append(f"array(struct({i} AS c, {self.root_part(o, t)} AS s))")
                continue
            tests = []
            for k, (name, _) in enumerate(keys):
                x = _name(name)
                tests.append(f"CASE WHEN c.at > {k} THEN {x} <=> c.v{k} WHEN c.at = {k} THEN "
                             f"coalesce({x} BETWEEN c.lo{k} AND c.hi{k}, c.nulls) ELSE true END")
            found.append(f"transform(filter(get({t}.parts, {self.root_part(o, t)}), c -> "
                         f"{' AND '.join(tests)}), c -> {value(o)})")
        return rows.select(*[_name(c) for c in self.columns],
                           F.expr(f"explode(concat({', '.join(found)}))").alias("_p"))

    def split(self, cells: list[_Cell]) -> list[_Cell]:
        """The parts of the cells that hold their places."""
        share = {o: self.cells // sum(c.order == o for c in cells) for o in {c.order for c in cells}}
        share = {o: max(2, n) for o, n in share.items()}

        def within(o):
            cases = [f"WHEN c.at = {k} THEN " + _part(
                _name(name), f"c.lo{k}", f"c.hi{k}", "c.same", self.types[name], asc, share[o])
                for k, (name, asc) in enumerate(self.orders[o]) if isinstance(self.types[name], _KEYS)]
            return f"struct(c.i AS c, CASE {' '.join(cases)} END AS s)"

        counted: dict[int, list] = {}
        for r in self.spread(cells, within).groupBy("_p.c", "_p.s").agg(*self.figures).collect():
            counted.setdefault(r["c"], []).append(r)
        out = []
        for i, c in enumerate(cells):
            before, places = c.before, sorted(c.places)
            for row in sorted(counted.get(i, []), key=lambda r: r["s"]):
                mine = [p for p in places if before < p <= before + row["n"]]
                if mine:
                    out.append(self.cell(c.order, c.at, c.fixed, row, before, row["s"] == share[c.order],
                                         mine, row["s"] if c.part is None else c.part))
                before += row["n"]
        return out

    def read(self, cells: list[_Cell]) -> dict[tuple[int, int], Hit]:
        """The keys at the places of cells that are small enough to be read."""
        held: dict[int, list] = {}
        for r in self.spread(cells, lambda o: "c.i").collect():
            held.setdefault(r["_p"], []).append(r)
        out = {}
        for i, c in enumerate(cells):
            keys = self.orders[c.order]
            rows = [tuple(r[name] for name, _ in keys) for r in held.get(i, [])]
            for k in range(len(keys) - 1, -1, -1):  # stable: the last key first
                rows = sorted((h for h in rows if h[k] is not None), key=lambda h: h[k],
                              reverse=not keys[k][1]) + [h for h in rows if h[k] is None]
            for p in c.places:
                key = rows[p - c.before - 1]
                out[c.order, p] = Hit(key, c.before + rows.index(key), rows.count(key), c.part)
        return out

    def reached(self, df: DataFrame, bounds: dict[str, tuple[int, list[tuple[Hit, bool]]]]) -> DataFrame:
        """``df`` with columns of how many of the bounds of an order a row stands at or behind (only
        behind, if a bound's flag is set).

        Bounds in other parts of the frame than the row's are counted beforehand.
        """
        out = {}
        for i, (column, (o, held)) in enumerate(bounds.items()):
            before, n, t = [], 0, f"_t{i}"
            counts = Counter(h.part for h, _ in held)
            for part in range(self.cells + 1):
                before.append(n)
                n += counts[part]
            df = df.withColumn(t, self.literals(o, [(h.part, {"strict": flag, **{
                f"v{k}": v for k, v in enumerate(h.key) if v is not None}}) for h, flag in held],
                "strict: boolean")).withColumn(f"_n{i}", F.from_json(F.lit(json.dumps(before)), "array<int>"))
            test = "NOT c.strict"
            for k, (name, asc) in reversed(list(enumerate(self.orders[o]))):
                x, sign = _name(name), ">" if asc else "<"
                test = (f"(c.v{k} IS NOT NULL AND coalesce({x} {sign} c.v{k}, true)) "
                        f"OR ({x} <=> c.v{k} AND ({test}))")
            part = self.root_part(o, t)
            out[column] = F.expr(f"get(_n{i}, {part}) + size(filter(get({t}.parts, {part}), c -> {test}))")
        kept = [c for c in df.columns if c not in out and not c.startswith(("_t", "_n"))]
        return df.select(*[_name(c) for c in kept], *[v.alias(c) for c, v in out.items()])


def select(df: DataFrame, orders: list[Order], places: Callable[[int], list[list[int]]],
           cells: int = CELLS, leaf: int = LEAF) -> tuple[_Passes, list[dict[int, Hit]]]:
    """The passes (with the number of rows, ``total``), and per order the rows at its places (from 1).

    ``places`` is given the number of rows and returns every order's places. Pass a stored
    frame: it is read once per pass.
    """
    df, back = _by_bits(df, orders)
    passes = _Passes(df, orders, cells)
    found, open_, leaves = {}, [], []
    todo = passes.roots if passes.total else []
    for root, wanted in zip(todo, places(passes.total)):
        root.places = sorted({p for p in wanted if 1 <= p <= passes.total})
    while todo:
        for c in todo:
            if not c.places:
                continue
            if c.at == len(orders[c.order]):
                found.update({(c.order, p): Hit(c.fixed, c.before, c.rows, c.part or 0) for p in c.places})
            else:
                # one histogram at least, however small the frame
                (open_ if c.part is None or c.rows > leaf else leaves).append(c)
        todo, open_ = passes.split(open_) if open_ else [], []
    if leaves:
        found.update(passes.read(leaves))
    return passes, [{p: Hit(back(o, h.key), h.before, h.equal, h.part)
                     for (i, p), h in found.items() if i == o} for o in range(len(orders))]


def _by_bits(df: DataFrame, orders: list[Order]):
    """Double keys replaced by integers in the same order, and the way back."""
    doubles = [c for c in dict.fromkeys(c for o in orders for c, _ in o)
               if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    if not doubles:
        return df, lambda o, key: key

    @F.pandas_udf("long")
    def bits(x: pd.Series) -> pd.Series:
        # -0.0 is 0.0 and every NaN the same one, above all numbers; nulls are put back outside
        raw = (x.to_numpy("float64") + 0.0).copy()
        raw[np.isnan(raw)] = np.nan
        b = raw.view("int64")
        return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b))

    def back(o, key):
        out = []
        for (c, _), v in zip(orders[o], key):
            if c in doubles and v is not None:
                b = np.int64(v)
                v = float(np.array([b ^ np.int64(0x7FFFFFFFFFFFFFFF) if b < 0 else b]).view("float64")[0])
            out.append(v)
        return tuple(out)

    return df.withColumns({c: F.when(F.col(c).isNotNull(), bits(F.coalesce(
        F.col(c).cast("double"), F.lit(0.0)))) for c in doubles}), back


@dataclass(frozen=True)
class Tiles:
    """One NTILE(n) column; ``order`` should be total."""

    name: str
    order: Order
    n: int


def tile_starts(rows: int, n: int) -> list[int]:
    """Places where the buckets 2 to n of NTILE(n) begin, if they have rows."""
    size, more = divmod(rows, n)
    starts = [(k - 1) * size + min(k - 1, more) + 1 for k in range(2, n + 1)]
    return [s for s in starts if s <= rows]


def ntiles(df: DataFrame, tiles: list[Tiles], **passes) -> DataFrame:
    """``df``, a stored frame, with a bucket number (bigint) per entry of ``tiles``.

    Rows that are equal in every key of an order get the same bucket.
    """
    passes, found = select(df, [t.order for t in tiles],
                           lambda n: [tile_starts(n, t.n) for t in tiles], **passes)
    out = passes.reached(df, {t.name: (o, [(found[o][s], False) for s in tile_starts(passes.total, t.n)])
                              for o, t in enumerate(tiles)})
    return out.withColumns({t.name: (F.col(t.name) + 1).cast("bigint") for t in tiles})


def add_rank(df: DataFrame, name: str, column: str, asc: bool = True, *,
             bucket_rows: int | None = None, **passes) -> DataFrame:
    """``df``, a stored frame, with the RANK of ``column`` over all rows.

    The values at every ``bucket_rows``-th place cut the frame into cells; the rows before a cell are
    known exactly, so a rank is that number plus the rank within the cell. A value that
    fills a cell alone is a cell of its own, in which all rows rank first: its
    rows are dealt over several tasks by a hash.
    """
    per = _bucket_rows(df, bucket_rows)
    def places(n):
        cells = max(MIN_CELLS, math.ceil(n / per))
        return [[n * k // cells + 1 for k in range(1, cells)]]

    found, (hits,) = select(df, [((column, asc),)], places, **passes)
    bounds, before, deal = [], [0], [1]
    for hit in sorted({h.key: h for h in hits.values()}.values(), key=lambda h: h.before):
        bounds.append((hit, False))
        before.append(hit.before)
        deal.append(math.ceil(hit.equal / per) if hit.equal >= per else 1)
        if hit.equal >= per:  # a cell of its own
            bounds.append((hit, True))
            before.append(hit.before + hit.equal)
            deal.append(1)
    lists = [F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in (before, deal)]
    x = F.col(column)
    cell = Window.partitionBy("_cell", "_deal").orderBy(
        x.asc_nulls_last() if asc else x.desc_nulls_last())
    rows = found.reached(df, {"_cell": (0, bounds)}).withColumn("_deal", F.pmod(
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.get(lists[1], F.col("_cell"))))
    return (rows.withColumn(name, F.get(lists[0], F.col("_cell")) + F.rank().over(cell))
            .drop("_cell", "_deal"))


def values_at(df: DataFrame, column: str, places: Callable[[int], list[int]],
              **passes) -> tuple[int, list]:
    """Number of rows, and the values of a column at the given places (from 1) of its order."""
    wanted: list[int] = []

    def at(n):
        wanted.extend(places(n))
        return [wanted]

    found, (hits,) = select(df, [((column, True),)], at, **passes)
    return found.total, [hits[p].key[0] if p in hits else None for p in wanted]
