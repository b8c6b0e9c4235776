"""Metadata blocks: runs of events that share attributes.

Rows have an order within a segment (a file, or a part of a stream); windows are always partitioned
by it, so a segment is what one task sorts: one file's worth of rows. For longer ones,
``assign_stitched`` numbers blocks from pieces of segments. A block is numbered within its segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "merge"
STRATEGIES = ("block", "add", "multiply", "and", "union", "append", "drop")


class MergeError(ValueError):
    """Blocks that can't be merged."""


def assign(events: DataFrame, segment: Sequence[str], order: Sequence[str], keys: Sequence[str], every: int | None = None) -> DataFrame:
    """``events`` with ``block``: a new one whenever a key changes within the segment, or at
    every ``every``-th row of it."""
    w = Window.partitionBy(*segment).orderBy(*order)
    new = F.lit(False)
    for k in keys:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    if every:
        new = new | (F.pmod(F.row_number().over(w) - 1, F.lit(every)) == 0)
    marked = events.withColumn("_new", (first | new).cast("long"))
    return marked.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def assign_stitched(events: DataFrame, segment: Sequence[str], order: str, keys: Sequence[str], piece: int) -> DataFrame:
    """``assign`` for segments of any length, in pieces of ``piece`` steps of the numeric ``order``: each
    piece is numbered by itself, and what it adds to the numbers after it (its changes, and whether its
    first row differs from the last row before it) comes from a table of one row a piece."""
    own = [*segment, "_piece"]
    w = Window.partitionBy(*own).orderBy(order)
    new = F.lit(False)
    for k in keys:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    cut = events.withColumn("_piece", F.floor(F.col(order) / piece))
    marked = cut.withColumn("_new", (new & (F.row_number().over(w) > 1)).cast("long")).withColumn("_inner", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*own).agg(F.max("_inner").alias("_changes"), F.min_by(F.struct(*keys), order).alias("_head"), F.max_by(F.struct(*keys), order).alias("_tail"))
    along = Window.partitionBy(*segment).orderBy("_piece")
    starts = (~F.col("_head").eqNullSafe(F.lag("_tail").over(along)) & (F.row_number().over(along) > 1)).cast("long")
    before = F.sum(F.col("_starts") + F.coalesce(F.col("_last"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    table = ends.withColumn("_starts", starts).withColumn("_last", F.lag("_changes").over(along)).select(*own, before.alias("_before"))
    return marked.join(table, own).withColumn("block", F.col("_before") + F.col("_inner")).drop("_piece", "_new", "_inner", "_before")


def manual(events: DataFrame, segment: Sequence[str], order: Sequence[str], mark: Column, metadata: Column, forward: bool = True) -> tuple[DataFrame, DataFrame]:
    """Blocks that the analysis cuts itself: (events with ``block``, (segment, block, metadata) of the marked
    rows). A marked event starts a block (forward) or is the last of one. Events before the first start,
    or after the last end, are in a block without metadata."""
    w = Window.partitionBy(*segment).orderBy(*order)
    marked = events.withColumns({"_mark": F.coalesce(mark, F.lit(False)).cast("long"), "_metadata": metadata})
    before = F.sum("_mark").over(w.rowsBetween(Window.unboundedPreceding, 0 if forward else -1))
    numbered = marked.withColumn("block", F.coalesce(before, F.lit(0)))
    return numbered.drop("_mark", "_metadata"), numbered.where("_mark = 1").select(*segment, "block", F.col("_metadata").alias("metadata"))


def with_metadata(stream: DataFrame, segment: Sequence[str], order: Sequence[str], metadata: str, forward: Column | None = None) -> DataFrame:
    """``stream`` with ``current``: the metadata that holds for each row. A metadata row holds for
    the rows after it, up to the next one; backward segments (``forward`` false) the other way.
    The other way rows are sorted backward too: frames that end with the segment are filled anew for each row."""

    def last(order: Sequence[Column]) -> Column:
        return F.last(metadata, ignorenulls=True).over(Window.partitionBy(*segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    after = last([F.col(c) for c in order])
    return stream.withColumn("current", after if forward is None else F.when(forward, after).otherwise(last([F.col(c).desc() for c in order])))


def changes(events: DataFrame, segment: Sequence[str], order: Sequence[str], block: str = "block") -> DataFrame:
    """``events`` with ``new_metadata``: true for the first row of each block."""
    w = Window.partitionBy(*segment).orderBy(*order)
    return events.withColumn("new_metadata", ~F.col(block).eqNullSafe(F.lag(block).over(w)))


def salient(events: DataFrame, segment: Sequence[str], order: Sequence[str], block: str = "block") -> DataFrame:
    """The first event of each block."""
    w = Window.partitionBy(*segment, block).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def strategies(schema: T.StructType) -> dict[str, str]:
    """Each field's strategy, from its ``merge`` metadata; without one, blocks must agree."""
    found = {f.name: f.metadata.get(KEY, "block") for f in schema.fields}
    for name, s in found.items():
        if s not in STRATEGIES:
            raise MergeError(f"{name}: no such strategy: {s}")
        if s in ("add", "multiply", "and") and isinstance(schema[name].dataType, T.ArrayType):
            raise MergeError(f"{name}: {s} of a repeated field")
    return found


def annotated(df: DataFrame, **how: str) -> DataFrame:
    """``df`` with merge strategies in its schema."""
    return df.select(*[F.col(c).alias(c, metadata={KEY: how[c]}) if c in how else F.col(c) for c in df.columns])


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(0).cast(kind)


def _merged(name: str, kind: T.DataType, how: str, order: Column) -> Column:
    """An aggregate; null only if no block has the field. A field that some blocks have reads as
    its default in the others."""
    value = F.coalesce(F.col(name), _default(kind)) if not isinstance(kind, T.StructType) else F.col(name)
    seen = F.count(F.col(name)) > 0
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])
    if how == "add":
        out = F.array_join(ordered, "") if isinstance(kind, T.StringType) else F.sum(value)
    elif how in ("multiply", "and"):
        out = F.array_join(ordered, "") if isinstance(kind, T.StringType) else F.bool_and(value) if isinstance(kind, T.BooleanType) else F.product(value)
    elif how == "union":
        each = F.flatten(F.collect_set(value)) if isinstance(kind, T.ArrayType) else F.collect_set(value)
        out = F.array_sort(F.array_distinct(each))
    elif how == "append":
        out = F.flatten(ordered) if isinstance(kind, T.ArrayType) else ordered
    elif how == "drop":
        return F.min_by(F.col(name), order).alias(name)
    else:
        same = F.min(value).eqNullSafe(F.max(value))
        return F.when(same, F.min(F.col(name))).otherwise(F.raise_error(F.lit(f"blocks differ in {name}"))).alias(name)
    return F.when(seen, out).alias(name)


def merge(blocks: DataFrame, by: Sequence[str], order: str, how: dict[str, str] | None = None) -> DataFrame:
    """One row for each value of ``by``, every other field merged by its strategy, in ``order``."""
    how = strategies(blocks.select(*[c for c in blocks.columns if c not in by and c != order]).schema) | (how or {})
    aggregates = [_merged(n, blocks.schema[n].dataType, s, F.col(order)) for n, s in how.items() if n not in by]
    return blocks.groupBy(*by).agg(*aggregates, F.min(order).alias(order))


def merge_per(blocks: DataFrame, key: str, segment: Sequence[str], order: str, how: dict[str, str] | None = None) -> DataFrame:
    """Merges blocks that follow each other with an equal key; a repeated key compares by its
    last value."""
    repeated = isinstance(blocks.schema[key].dataType, T.ArrayType)
    compared = F.element_at(key, -1) if repeated else F.col(key)
    w = Window.partitionBy(*segment).orderBy(order)
    new = (~compared.eqNullSafe(F.lag(compared).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    islands = blocks.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    how = strategies(blocks.select(*[c for c in blocks.columns if c not in (*segment, order)]).schema) | (how or {})
    if not repeated:
        how = {k: v for k, v in how.items() if k != key}
        aggregates = [F.first(key).alias(key)]
    else:
        aggregates = []
    aggregates += [_merged(n, blocks.schema[n].dataType, s, F.col(order)) for n, s in how.items()]
    return islands.groupBy(*segment, "_island").agg(*aggregates, F.min(order).alias(order), F.count("*").alias("merged")).drop("_island")


def split_per(df: DataFrame, key: str, path: str) -> None:
    """One folder for each value of ``key``, which must have one value in a row."""
    if isinstance(df.schema[key].dataType, T.ArrayType):
        several = df.where(F.size(key) != 1)
        if not several.isEmpty():
            raise MergeError(f"{key} has several values in a block")
        df = df.withColumn(key, F.get(key, F.lit(0)))
    df.write.partitionBy(key).parquet(path)


def summary(events: DataFrame, by: Sequence[str], weight: str, lumiblock: str, streams: str | None = None) -> DataFrame:
    """Metadata of events: counts, summed weights, the lumiblocks seen, and the streams (an array column)
    that all events have."""
    out = [F.count("*").alias("event_count"), F.sum(weight).alias("sum_mc_weights"), F.array_sort(F.collect_set(lumiblock)).alias("lumiblocks")]
    if streams is None:
        return events.groupBy(*by).agg(*out)
    totals = events.groupBy(*by).agg(*out)
    each = events.select(*by, F.explode(F.array_distinct(streams)).alias("_s")).groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    common = totals.select(*by, "event_count").join(each, list(by)).where(F.col("_n") == F.col("event_count")).groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("streams"))
    return totals.join(common, list(by), "left").withColumn("streams", F.coalesce("streams", F.array().cast(common.schema["streams"].dataType)))
