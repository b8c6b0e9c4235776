"""Between flat columns and nested records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE, PREFIX = "source_column", "source_prefix"
UNSET = -999
#: What a column may become besides itself: whole numbers a wider one, or true where they aren't 0. A long
#: may become an int, as the native one of a machine's word size may; it overflows loudly.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "boolean"), "smallint": ("int", "bigint", "boolean"), "int": ("bigint", "boolean"),
    "bigint": ("int", "decimal(20,0)", "boolean"), "float": ("double",), "boolean": (), "double": (), "string": (), "decimal(20,0)": ("boolean",),
}


def converted(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A cast, if it is one that is allowed."""
    a, b = have.simpleString(), want.simpleString()
    if a != b and b not in _WIDER.get(a, ()):
        raise TypeError(f"{a} doesn't convert to {b}")
    return value.cast(want)


def _each(values: Column, have: T.DataType, kind: T.DataType) -> Column:
    if not isinstance(have, T.ArrayType):
        raise TypeError(f"{have.simpleString()} is no repeated column")
    converted(values, have.elementType, kind)
    return F.transform(values, lambda x: x.cast(kind))


def _field(records: Column, name: str, unset: float) -> Column:
    return F.transform(records, lambda o: F.coalesce(o[name].cast("double"), F.lit(unset)))


def _nested(df: DataFrame, schema: T.StructType, prefix: str) -> list[Column]:
    have, out = {f.name: f.dataType for f in df.schema.fields}, []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            own = _nested(df, f.dataType, prefix + f.metadata.get(PREFIX, ""))
            out.append(F.struct(*own).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inner = f.dataType.elementType
            names = [(g, prefix + f.metadata.get(PREFIX, "") + g.metadata.get(SOURCE, g.name)) for g in inner.fields]
            out.append(zipped({g.name: _each(F.col(c), have[c], g.dataType) for g, c in names if c in have}, [g.name for g, _ in names], {g.name: g.dataType for g, _ in names}).alias(f.name))
        else:
            c = prefix + f.metadata.get(SOURCE, f.name)
            value = converted(F.col(c), have[c], f.dataType) if c in have else F.lit(None).cast(f.dataType)
            out.append(value.alias(f.name))
    return out


def zipped(columns: Mapping[str, Column], names: Sequence[str], types: Mapping[str, T.DataType]) -> Column:
    """Parallel arrays as an array of records. The first one gives the length; the others are
    left out (null) in rows where theirs differs."""
    first = next(iter(columns.values()))

    def record(_, i: Column) -> Column:
        return F.struct(*[(F.when(F.size(columns[n]) == F.size(first), F.get(columns[n], i)) if n in columns else F.lit(None)).cast(types[n]).alias(n) for n in names])

    return F.transform(first, record)


def nest(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` as ``schema`` says: field metadata ``source_column`` and ``source_prefix`` name the
    columns. Only those columns are read."""
    return df.select(*_nested(df, schema, ""))


def null_if_default(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) != F.lit(v), F.col(c)) for c, v in defaults.items()})


def with_defaults(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` in ``schema``: columns it lacks are there, and absent values read as defaults."""
    zero = {"string": "", "boolean": False}
    out = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        default = (defaults or {}).get(f.name, zero.get(f.dataType.simpleString(), 0 if isinstance(f.dataType, T.NumericType) else None))
        out.append((F.coalesce(value, F.lit(default).cast(f.dataType)) if default is not None else value).alias(f.name))
    return df.select(*out)


def flatten(df: DataFrame, unset: float = UNSET, depth: int = 2) -> DataFrame:
    """Columns ``a_b`` for nested fields to ``depth``; repeated records become one array for each
    field; absent numbers are ``unset``; texts are left out."""
    out = []

    def visit(value: Column, name: str, kind: T.DataType, level: int) -> None:
        if isinstance(kind, T.StructType):
            if level < depth:
                for f in kind.fields:
                    visit(value[f.name], f"{name}_{f.name}", f.dataType, level + 1)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if level < depth:
                for f in kind.elementType.fields:
                    if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                        out.append(_field(value, f.name, float(unset)).alias(f"{name}_{f.name}"))
        elif isinstance(kind, T.ArrayType):
            out.append(value.alias(name))
        elif isinstance(kind, T.BooleanType):
            out.append(F.coalesce(value, F.lit(bool(unset))).alias(name))
        elif isinstance(kind, T.NumericType):
            out.append(F.coalesce(value, F.lit(unset).cast(kind)).alias(name))

    for f in df.schema.fields:
        visit(F.col(f.name), f.name, f.dataType, 0)
    return df.select(*out)
