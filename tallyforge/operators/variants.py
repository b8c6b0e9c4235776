"""Channels and systematic variations: the same analysis again under another path.

Every event is analysed as it is (the nominal variant) and once more for each variant that it
takes part in; each systematic variation runs its channels too. Instead of running again, rows
fan out by the array of their variants, and the variant is one more part of the path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANT = "variant"


def fan_out(events: DataFrame, channels: Mapping[str, Column] | None = None, systematics: Mapping[str, Mapping[str, Column]] | None = None, channel_name: Column | None = None) -> DataFrame:
    """``events`` with ``variant`` ('' is nominal), ``systematic`` and ``channel``.

    channels: name -> condition under which the event is in it. channel_name: a column that names
    the one channel of an event. systematics: name -> {column: shifted value}."""
    channels, systematics = dict(channels or {}), dict(systematics or {})
    if not channels.keys().isdisjoint({""}) or "" in systematics:
        raise ValueError("the empty name is the nominal variant")
    shifts = F.explode(F.array(*[F.lit(s) for s in ["", *systematics]]))
    rows = events.withColumn("systematic", shifts)
    changed = {}
    for name, columns in systematics.items():
        for column, value in columns.items():
            changed[column] = F.when(F.col("systematic") == name, value).otherwise(changed.get(column, F.col(column)))
    rows = rows.withColumns(changed) if changed else rows
    named = [F.when(test, F.lit(n)) for n, test in channels.items()] + ([channel_name] if channel_name is not None else [])
    own = F.filter(F.array(F.lit(""), *named), lambda c: c.isNotNull())
    rows = rows.withColumn("channel", F.explode(own))
    prefix = F.concat(
        F.when(F.col("systematic") == "", "").otherwise(F.concat(F.lit("systematic/"), "systematic", F.lit("/"))),
        F.when(F.col("channel") == "", "").otherwise(F.concat(F.lit("channel/"), "channel", F.lit("/"))),
    )
    return rows.withColumn(VARIANT, prefix)


def skim_events(events: DataFrame, keep: Column, systematics: Mapping[str, Mapping[str, Column]] | None = None, channels: Mapping[str, Column] | None = None) -> DataFrame:
    """Events for which ``keep`` holds in any variant, that is as they are, or with a systematic's shifts,
    or in a channel they are in: a filter, as all variants of an event are within its row. ``keep``
    may name ``systematic``, ``channel`` and ``variant``."""
    names = ["systematic", "channel", VARIANT]
    rows = events.withColumn("_row", F.struct(*events.columns)).withColumn("_keep", F.lit(False))
    for systematic, columns in [("", {}), *(systematics or {}).items()]:
        rows = rows.withColumns({c: v for c, v in columns.items()}) if columns else rows
        for channel, test in [("", F.lit(True)), *(channels or {}).items()]:
            prefix = (f"systematic/{systematic}/" if systematic else "") + (f"channel/{channel}/" if channel else "")
            rows = rows.withColumns({n: F.lit(v) for n, v in zip(names, (systematic, channel, prefix), strict=True)})
            rows = rows.withColumn("_keep", F.col("_keep") | F.coalesce(test & keep, F.lit(False)))
        rows = rows.withColumns({c: F.col("_row")[c] for c in columns}) if columns else rows
    return rows.where("_keep").select("_row.*")


def skim(rows: DataFrame, keep: Column, key: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Each event once if ``keep`` holds in any of its variants."""
    keys = [key] if isinstance(key, str) else key
    passed = rows.where(keep)
    nominal_first = passed.withColumn("_v", F.col(VARIANT)) if VARIANT in rows.columns else passed.withColumn("_v", F.lit(""))
    names = columns or [c for c in rows.columns if c not in (VARIANT, "systematic", "channel", *keys)]
    return nominal_first.groupBy(*keys).agg(F.min_by(F.struct(*names), "_v").alias("e")).select(*keys, "e.*") if names else passed.select(*keys).distinct()


def shifted(cells: DataFrame) -> DataFrame:
    """(path, bx, source, shift): cells below ``systematic/<s>/`` against the nominal ones. A cell
    that only one side has counts as 0 on the other, for each source that has the path."""
    parsed = cells.withColumns({"source": F.regexp_extract("path", "^systematic/([^/]+)/", 1), "base": F.regexp_replace("path", "^systematic/[^/]+/", "")})
    cell = [c for c in cells.columns if c not in ("path", "sumw", "sumw2", "entries")]
    moved = parsed.where("source <> ''").select("base", *cell, "source", F.col("sumw").alias("part"))
    nominal = parsed.where("source = ''").select("base", *cell, (-F.col("sumw")).alias("part"))
    sides = moved.unionByName(nominal.join(moved.select("base", "source").distinct(), "base"))
    return sides.groupBy("base", *cell, "source").agg(F.sum("part").alias("shift")).select(F.col("base").alias("path"), "bx", "source", "shift")
