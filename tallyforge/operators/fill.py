"""Filling many named, weighted histograms and cut-flow counters in one job.

A ``Store`` is a cheap view: a path prefix and the current weight. It collects fills; ``run``
turns them into one DataFrame of cells

    path, kind, bx, by, bz, cut, ordinal, sumw, sumw2, entries

The *once* plan, the default, reads the input once: each fill is a column with the number of the cell
it hits (null where it doesn't hold), these columns are unpivoted, and rows are aggregated by that one
number; paths and bins are worked out from it afterwards, for the cells only. Fills whose paths
have the same parts taken from the events share one such read. The *union* plan gives each fill
its own scan of its own columns, which pays where fills need few columns of a very wide input.
Aggregation state and shuffle are as large as the histograms and not as the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["path", "kind", "bx", "by", "bz", "cut", "ordinal"]
SUMS = ["sumw", "sumw2", "entries"]
#: A cell's number is that of its fill, times 2 to this power, and its place in the dense histogram.
PLACES = 40


@dataclass
class Fill:
    """One weighted fill; ``parts`` are the texts and Columns that make its path."""

    parts: tuple
    kind: str
    axes: tuple
    values: tuple
    weight: Column
    where: Column | None
    cut: str | None = None
    ordinal: int | None = None

    @property
    def path(self) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in self.parts or ("",)])

    def place(self) -> Column:
        """The place in the dense histogram, with under- and overflow."""
        out, size = F.lit(0).cast("long"), 1
        for axis, value in zip(self.axes, self.values, strict=True):
            out, size = out + axis.bin(value).cast("long") * size, size * (axis.bins + 2)
        return out

    def cell(self) -> list[Column]:
        at = [a.bin(v).cast("int") for a, v in zip(self.axes, self.values, strict=True)]
        at += [F.lit(None).cast("int")] * (3 - len(at))
        names = [self.path.alias("path"), F.lit(self.kind).alias("kind"), *[a.alias(n) for a, n in zip(at, ("bx", "by", "bz"), strict=True)]]
        return [*names, F.lit(self.cut).cast("string").alias("cut"), F.lit(self.ordinal).cast("int").alias("ordinal")]


@dataclass
class _Book:
    fills: list[Fill] = field(default_factory=list)
    kinds: dict[str, tuple] = field(default_factory=dict)
    cuts: dict[str, list[str]] = field(default_factory=dict)


def _joined(*parts) -> tuple:
    """Parts of a path, with texts that follow each other joined."""
    out: list = []
    for p in parts:
        p = p if isinstance(p, Column) else str(p)
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif isinstance(p, Column) or p:
            out.append(p)
    return tuple(out)


class Store:
    """Named aggregates below ``prefix``, filled with the current weight."""

    def __init__(self, prefix: str | Column | tuple = "", weight: Column | float = 1.0, book: _Book | None = None, key: str | None = None):
        self._parts = prefix if isinstance(prefix, tuple) else _joined(prefix)
        self._key = key if key is not None else "".join(p if isinstance(p, str) else "*" for p in self._parts)
        self._weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        self.book = book or _Book()

    def __call__(self, *parts) -> Store:
        """A view further down the path, with the same weight."""
        text = "".join(str(p) if not isinstance(p, Column) else "*" for p in parts)
        return Store(_joined(*self._parts, *parts), self._weight, self.book, self._key + text)

    @property
    def weight(self) -> Column:
        return self._weight

    def set_weight(self, weight: Column | float) -> Store:
        self._weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        return self

    def mul_weight(self, weight: Column | float) -> Store:
        self._weight = self._weight * weight
        return self

    def _declare(self, path: str, shape: tuple) -> None:
        if self.book.kinds.setdefault(path, shape) != shape:
            raise TypeError(f"{path} is already a {self.book.kinds[path][0]} of another shape")

    def _hist(self, name: str, axes: Sequence, values: Sequence[Column], weight, where) -> Store:
        kind = f"H{len(axes)}"
        self._declare(self._key + name, (kind, *axes))
        own = self._weight if weight is None else self._weight * weight
        self.book.fills.append(Fill(_joined(*self._parts, name), kind, tuple(axes), tuple(values), own, where))
        return self

    def h1(self, name: str, axis, x: Column, weight=None, where: Column | None = None) -> Store:
        return self._hist(name, [axis], [x], weight, where)

    def h2(self, name: str, ax, x: Column, ay, y: Column, weight=None, where: Column | None = None) -> Store:
        return self._hist(name, [ax, ay], [x, y], weight, where)

    def h3(self, name: str, ax, x: Column, ay, y: Column, az, z: Column, weight=None, where: Column | None = None) -> Store:
        return self._hist(name, [ax, ay, az], [x, y, z], weight, where)

    def order(self, name: str, *cuts: str) -> Store:
        """Declares counters, in this order, that are there even if nothing passes."""
        self._declare(self._key + name, ("CUTFLOW",))
        own = self.book.cuts.setdefault(self._key + name, [])
        own += [c for c in cuts if c not in own]
        return self

    def passed(self, name: str, cut: str, where: Column | None = None, weight=None) -> Store:
        self.order(name, cut)
        own = self._weight if weight is None else self._weight * weight
        ordinal = self.book.cuts[self._key + name].index(cut)
        self.book.fills.append(Fill(_joined(*self._parts, name), "CUTFLOW", (), (), own, where, cut, ordinal))
        return self

    def list(self, kind: str | None = None) -> list[str]:
        return sorted(p for p, shape in self.book.kinds.items() if kind in (None, shape[0]))

    def find(self, path: str, kind: str) -> tuple | None:
        shape = self.book.kinds.get(path)
        return shape if shape and shape[0] == kind else None

    def run(self, events: DataFrame, plan: str = "once", keys: Sequence[str] = ()) -> DataFrame:
        """The cells of all fills, one set for each value of ``keys`` (columns of ``events``)."""
        return fill(events, self.book.fills, plan, keys)


def _union(events: DataFrame, fills: list[Fill], keys: Sequence[str]) -> DataFrame:
    """A row for each fill and event. Union is narrow: each branch is aggregated by its own tasks
    before the one shuffle that all of them share."""
    parts = [(events if f.where is None else events.where(f.where)).select(*keys, *f.cell(), f.weight.cast("double").alias("w")) for f in fills]
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Reading:
    """Fills that one read of the input serves: their paths have the same Columns in them."""

    fills: list[Fill]
    keys: Sequence[str]

    def __post_init__(self):
        weights = {id(f.weight): f.weight for f in self.fills}
        self.weights = list(weights.values())
        # fills of one weight are numbered in a row, so a cell's number tells its weight
        self.fills = sorted(self.fills, key=lambda f: list(weights).index(id(f.weight)))
        self.parts = [p for p in self.fills[0].parts if isinstance(p, Column)]

    @property
    def by(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self.keys))] + [f"_p{i}" for i in range(len(self.parts))]

    def rows(self, events: DataFrame) -> DataFrame:
        """``by``, cell and w: a row for each fill that holds."""
        own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)] + [p.cast("string").alias(f"_p{i}") for i, p in enumerate(self.parts)]
        own += [w.cast("double").alias(f"_w{i}") for i, w in enumerate(self.weights)]
        cells = []
        for i, f in enumerate(self.fills):
            cell = F.lit(i << PLACES) + f.place()
            cells.append((cell if f.where is None else F.when(f.where, cell)).alias(f"_c{i}"))
        wide = events.select(*own, *cells)
        ids = [*self.by, *(f"_w{i}" for i in range(len(self.weights)))]
        if len(cells) == 1:
            rows = wide.withColumnRenamed("_c0", "cell")
        else:
            rows = wide.unpivot(ids, [f"_c{i}" for i in range(len(cells))], "fill", "cell")
        weight, n = F.col(f"_w{len(self.weights) - 1}"), len(self.fills)
        for i in range(len(self.weights) - 2, -1, -1):
            n = next(k for k, f in enumerate(self.fills) if f.weight is self.weights[i + 1])
            weight = F.when(F.col("cell") < (n << PLACES), F.col(f"_w{i}")).otherwise(weight)
        return rows.where("cell IS NOT NULL").select(*self.by, "cell", weight.alias("w"))

    def named(self, cells: DataFrame) -> DataFrame:
        """``cells`` with the keys' own names, and path, kind, bins, cut and ordinal for its number."""
        rest = [c for c in cells.columns if c not in (*self.by, "cell")]
        about = []
        for f in self.fills:
            texts, expect = [], True
            for p in f.parts:
                texts += [""] if isinstance(p, Column) and expect else []
                texts += [p] if isinstance(p, str) else []
                expect = isinstance(p, Column)
            texts += [""] * (len(self.parts) + 1 - len(texts))
            sizes = [F.lit(a.bins + 2 if a else None).cast("long") for a in (*f.axes, None, None, None)[:3]]
            about.append(F.struct(
                F.array(*map(F.lit, texts)).alias("texts"), F.lit(f.kind).alias("kind"), *[s.alias(n) for s, n in zip(sizes, ("nx", "ny", "nz"), strict=True)],
                F.lit(f.cut).cast("string").alias("cut"), F.lit(f.ordinal).cast("int").alias("ordinal"),
            ))
        found = cells.withColumns({"_f": F.get(F.array(*about), F.shiftright("cell", PLACES).cast("int")), "_at": F.col("cell").bitwiseAND(F.lit((1 << PLACES) - 1))})
        f, at = F.col("_f"), F.col("_at")
        path = F.concat(f["texts"][0], *[x for i in range(len(self.parts)) for x in (F.col(f"_p{i}"), f["texts"][i + 1])])
        nx, ny, nz = f["nx"], f["ny"], f["nz"]
        along = lambda size, below: F.when(size.isNotNull(), F.pmod(F.floor(at / below), size)).cast("int")
        return found.select(
            *[F.col(f"_k{i}").alias(k) for i, k in enumerate(self.keys)], path.alias("path"), f["kind"].alias("kind"),
            along(nx, F.lit(1)).alias("bx"), along(ny, nx).alias("by"), along(nz, nx * ny).alias("bz"), f["cut"].alias("cut"), f["ordinal"].alias("ordinal"), *rest,
        )


def readings(fills: list[Fill], keys: Sequence[str]) -> list[Reading]:
    groups: dict[tuple, list[Fill]] = {}
    for f in fills:
        groups.setdefault(tuple(id(p) for p in f.parts if isinstance(p, Column)), []).append(f)
    return [Reading(g, keys) for g in groups.values()]


def sums() -> list[Column]:
    return [F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"), F.count("*").alias("entries")]


def may_meet(fills: list[Fill]) -> bool:
    """Whether cells of two fills can be the same cell."""
    names = [(f.parts, f.cut) for f in fills]
    return any(isinstance(p, Column) for parts, _ in names for p in parts) or len(set(names)) < len(names)


def fill(events: DataFrame, fills: list[Fill], plan: str = "once", keys: Sequence[str] = ()) -> DataFrame:
    if plan not in ("once", "union"):
        raise ValueError(f"no such plan: {plan}")
    if not fills:
        raise ValueError("nothing is filled")
    if plan == "union":
        return _union(events, fills, keys).groupBy(*keys, *CELL).agg(*sums())
    parts = [r.named(r.rows(events).groupBy(*r.by, "cell").agg(*sums())) for r in readings(fills, keys)]
    cells = reduce(DataFrame.unionByName, parts)
    # few rows are left: cells, and not events
    return cells.groupBy(*keys, *CELL).agg(*[F.sum(c).alias(c) for c in SUMS]) if may_meet(fills) else cells
