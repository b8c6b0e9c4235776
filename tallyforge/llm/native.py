"""Column helpers that stay inside Spark's own expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def match_spans(text: Column, regex: str, group: int = 0) -> Column:
    """Array of (start, end, value, part) of all leftmost non-overlapping matches: code points,
    end exclusive; ``part`` is the text of ``group``.

    A match begins after all the text between and within the matches before it. Those sums are
    taken in blocks, so a text of n matches costs about n * (128 + n / 128) additions."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    gaps = F.transform(F.split(text, regex, -1), F.length)

    def placed(values, parts, gaps):
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), F.transform(values, F.length), lambda g, v: g + v)

        def starts(steps):
            blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))
            sums = F.transform(blocks, lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
            bases = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
            return let(
                bases,
                lambda base: F.transform(
                    steps,
                    lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int"))
                    + total(F.slice(steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
                    + F.get(gaps, i),
                ),
            )

        begin = let(steps, starts)
        return let(
            begin,
            lambda s: F.transform(
                values,
                lambda v, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(v)).alias("end"), v.alias("value"), F.get(parts, i).alias("part")),
            ),
        )

    found = let(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda values: F.when(F.size(values) > 0, let(
            F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else values,
            lambda parts: let(gaps, lambda g: placed(values, parts, g)),
        )),
    )
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int,value:string,part:string>>"))
