"""Good-run lists: inclusive ranges of lumiblocks (run, lo, hi)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Range lists up to so many rows are sent to every task; larger ones are joined by run.
BROADCAST_ROWS = 1_000_000


def passing(events: DataFrame, ranges: DataFrame, run: str, lumiblock: str, rows: int | None = None) -> DataFrame:
    """Events whose run and lumiblock are in a range. Ranges may overlap."""
    rows = ranges.count() if rows is None else rows
    side = F.broadcast(ranges) if rows <= BROADCAST_ROWS else ranges
    test = (events[run] == ranges["run"]) & events[lumiblock].between(ranges["lo"], ranges["hi"])
    return events.join(side, test, "left_semi")


def expand(ranges: DataFrame) -> DataFrame:
    return ranges.where("lo <= hi").select("run", F.explode(F.sequence("lo", "hi")).alias("lumiblock")).distinct()


def compress(lumiblocks: DataFrame) -> DataFrame:
    """Ranges of consecutive lumiblocks of (run, lumiblock)."""
    w = Window.partitionBy("run").orderBy("lumiblock")
    islands = lumiblocks.select("run", "lumiblock").distinct().withColumn("island", F.col("lumiblock") - F.row_number().over(w))
    return islands.groupBy("run", "island").agg(F.min("lumiblock").alias("lo"), F.max("lumiblock").alias("hi")).drop("island")


def intersection(*lists: DataFrame) -> DataFrame:
    """Ranges that all lists have."""
    return compress(reduce(lambda a, b: a.intersect(b), [expand(x) for x in lists]))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs that only one of two lists has, and which (a or b)."""
    ra, rb = a.select("run").distinct(), b.select("run").distinct()
    only = lambda x, y, name: x.join(y, "run", "left_anti").withColumn("only_in", F.lit(name))
    return only(ra, rb, "a").unionByName(only(rb, ra, "b"))
