"""Aggregates of a user's own that are stored, merged and scaled as histograms are."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How two values of a field become one; all of them can be taken in any order and in parts.
MERGES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or, "product": F.product,
    "union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
}


@dataclass(frozen=True)
class Aggregate:
    """A kind of result: for each field its value for one event and how values are merged; ``scaled``
    names the fields that a weight multiplies, with the power it does so by."""

    kind: str
    fields: Mapping[str, tuple[Column, str]]
    scaled: Mapping[str, int] | None = None

    def __post_init__(self):
        for name, (_, how) in self.fields.items():
            if how not in MERGES:
                raise ValueError(f"{name}: no such merge: {how}")

    def _merged(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.groupBy(*by, "path", "kind").agg(*[MERGES[how](F.col(n)).alias(n) for n, (_, how) in self.fields.items()])

    def fill(self, events: DataFrame, path: str | Column, where: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
        """(keys, path, kind, fields) over the events for which ``where`` holds."""
        chosen = events if where is None else events.where(where)
        path = path if isinstance(path, Column) else F.lit(path)
        values = [(F.array(v) if how == "union" and not repeated else v).alias(n) for n, (v, how), repeated in ((n, x, self._repeated(chosen, x[0])) for n, x in self.fields.items())]
        return self._merged(chosen.select(*keys, path.alias("path"), F.lit(self.kind).alias("kind"), *values), keys)

    @staticmethod
    def _repeated(events: DataFrame, value: Column) -> bool:
        return events.select(value.alias("v")).schema["v"].dataType.simpleString().startswith("array")

    def merge(self, *results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        whole = results[0]
        for r in results[1:]:
            whole = whole.unionByName(r)
        return self._merged(whole.where(F.col("kind") == self.kind), keys)

    def scale(self, results: DataFrame, by: Column | float) -> DataFrame:
        by = by if isinstance(by, Column) else F.lit(float(by))
        return results.withColumns({n: F.col(n) * F.pow(by, F.lit(float(power))) for n, power in (self.scaled or {}).items()})
