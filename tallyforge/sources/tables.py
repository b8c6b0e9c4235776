"""Reading and writing events, blocks and results as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import CELL


def read_events(spark: SparkSession, paths: Sequence[str], check_duplicates: bool = True, schema=None, merge_schemas: bool = False) -> DataFrame:
    """All files as one table; naming a file twice is an error unless it is allowed. ``merge_schemas``
    reads every file's footer to find columns that only some have; a given ``schema`` does without."""
    paths = list(paths)
    if check_duplicates and len(set(paths)) != len(paths):
        raise ValueError(f"named twice: {sorted({p for p in paths if paths.count(p) > 1})}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("mergeSchema", str(merge_schemas).lower()).parquet(*paths)


def write_events(events: DataFrame, path: str, split_by: Sequence[str] = (), files: int | None = None, compression: str = "zstd") -> None:
    """One folder for each value of ``split_by``. A value's rows stay spread over tasks."""
    out = events if files is None else events.coalesce(files)
    writer = out.write.option("compression", compression)
    (writer.partitionBy(*split_by) if split_by else writer).parquet(path)


def write_results(cells: DataFrame, path: str) -> None:
    cells.write.parquet(path)


def read_results(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    cells = spark.read.parquet(path)
    missing = [c for c in [*CELL, "sumw", "sumw2", "entries"] if c not in cells.columns]
    if missing:
        raise ValueError(f"these are no results: {missing} missing")
    return cells if kind is None else cells.where(F.col("kind") == kind)


def concatenate(*parts: DataFrame) -> DataFrame:
    """Streams one after another: ``segment`` numbers the parts."""
    numbered = [p.withColumn("segment", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def by_kind(results: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stored results, each kind through its handler; kinds without one are left out."""
    parts = [f(results.where(F.col("kind") == kind)) for kind, f in handlers.items()]
    return reduce(DataFrame.unionByName, parts)


def metadata_only(stream: DataFrame, *columns: str) -> DataFrame:
    """Blocks without events: rows that have any of the metadata ``columns``, and those alone."""
    test = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return stream.where(test)


def footers(stream: DataFrame, class_column: str = "_class", segment: str = "segment") -> DataFrame:
    """What each segment holds: rows by class."""
    return stream.groupBy(segment, class_column).agg(F.count("*").alias("count"))
