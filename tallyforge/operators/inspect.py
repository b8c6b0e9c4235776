"""Looking into tables: statistics, counts, selections, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINELS = (-999.0, -9999.0, -99999.0)


def field_stats(df: DataFrame, fields: Sequence[str] | None = None, sentinels: Sequence[float] = SENTINELS) -> DataFrame:
    """A row for each numeric field: n, total, mean, population stddev, min, max, and the second
    smallest and largest distinct values; absent values and sentinels don't count.

    Two passes of one aggregation each over all fields side by side: rows aren't multiplied, and
    one row reaches the driver in between."""
    names = list(fields or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    numbered = df.select(*[F.when(~F.col(n).cast("double").isin(*sentinels), F.col(n).cast("double")).alias(f"f{i}") for i, n in enumerate(names)])
    measures = {"n": F.count, "total": F.sum, "mean": F.avg, "stddev": F.stddev_pop, "min": F.min, "max": F.max}
    one = numbered.agg(*[f(f"f{i}").alias(f"{m}{i}") for i in range(len(names)) for m, f in measures.items()]).first()
    inner = lambda f, i, test: f(F.when(test, F.col(f"f{i}")))
    ends = numbered.agg(
        *[inner(F.min, i, F.col(f"f{i}") > F.lit(one[f"min{i}"]).cast("double")).alias(f"min1_{i}") for i in range(len(names))],
        *[inner(F.max, i, F.col(f"f{i}") < F.lit(one[f"max{i}"]).cast("double")).alias(f"max1_{i}") for i in range(len(names))],
    )
    rows = [
        F.struct(F.lit(n).alias("field"), *[F.lit(one[f"{m}{i}"]).cast("long" if m == "n" else "double").alias(m) for m in measures], F.col(f"min1_{i}").alias("min1"), F.col(f"max1_{i}").alias("max1"))
        for i, n in enumerate(names)
    ]
    return ends.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def class_counts(df: DataFrame, class_column: str = "_class") -> DataFrame:
    return df.groupBy(class_column).agg(F.count("*").alias("n"))


def class_sizes(df: DataFrame, class_column: str) -> DataFrame:
    """Rows, set fields and about how many bytes (as JSON) each class has."""
    rest = [c for c in df.columns if c != class_column]
    held = sum((F.col(c).isNotNull().cast("long") for c in rest), F.lit(0))
    return df.select(class_column, held.alias("h"), F.length(F.to_json(F.struct(*rest))).alias("b")).groupBy(class_column).agg(F.count("*").alias("n"), F.sum("h").alias("fields"), F.sum("b").alias("bytes"))


def select_equal(df: DataFrame, **values: str) -> DataFrame:
    """Rows whose fields, as text, are equal to all of ``values``."""
    for name, value in values.items():
        df = df.where(F.col(name).cast("string") == value)
    return df


def dump(df: DataFrame, order: Sequence[str], start: int = 0, count: int | None = None, **values: str) -> DataFrame:
    """``count`` rows from ``start`` on in order; the selection comes after the count."""
    rows = df.orderBy(*order)
    rows = rows.offset(start) if start else rows
    rows = rows if count is None else rows.limit(count)
    return select_equal(rows, **values)


def lines(df: DataFrame, order: Sequence[str], start: int = 0, count: int | None = None) -> DataFrame:
    """Rows as text, one JSON line each, as a dump prints them."""
    return dump(df, order, start, count).select(F.to_json(F.struct(*df.columns)).alias("line"))


def pick(df: DataFrame, column: str, numbers: Sequence[int]) -> DataFrame:
    return df.where(F.col(column).isin(*numbers))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side`` (- only in a, + only in b)."""
    signed = a.withColumn("_n", F.lit(-1)).unionByName(b.withColumn("_n", F.lit(1)))
    more = signed.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") < 0, "-").otherwise("+")
    return more.select(*a.columns, side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_n")))).drop("col")


def run_counts(df: DataFrame, path: str, weight: str) -> DataFrame:
    """Rows and weights by the run number guessed from a file name."""
    run = F.regexp_extract(path, r"\.(\d{6,8})\.", 1)
    return df.groupBy(run.alias("run")).agg(F.count("*").alias("n"), F.sum(weight).alias("sum_w"))
