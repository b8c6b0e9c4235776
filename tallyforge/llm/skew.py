"""Joins to a table of one row a key, where a few keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if at least HOT_ROWS rows and one row in HOT_KEYS hold it, so at most HOT_KEYS are.
HOT_ROWS, HOT_KEYS = 1000, 4000


def heaviest(table: DataFrame, weight: str) -> tuple[int, int]:
    """The largest weight of a key, and the sum of all."""
    top = table.agg(F.max(weight).alias("most"), F.sum(weight).alias("all")).first()
    return top["most"] or 0, top["all"] or 0


def join_keys(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", top: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` joined (inner or left) on the columns ``on`` with ``table``, which has one row a key and
    whose column ``weight`` says how many of ``rows`` hold it. ``top``: what ``heaviest`` says of it.

    Hot keys' rows of ``table`` are broadcast, at most HOT_KEYS of them, so their rows of ``rows`` stay
    where they are; those of all other keys meet in a shuffle in which no key is large. ``table`` is
    read three times and has columns of fixed width, which bounds the broadcast in bytes."""
    most, total = top or heaviest(table, weight)
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    if most < least:
        return rows.join(table, on, how)
    hot, cold = F.broadcast(table.where(F.col(weight) >= least)), table.where(F.col(weight) < least)
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on, how))
