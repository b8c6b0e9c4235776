"""The same fills over a stream: cells are sums, so they can be kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fill import CELL, Store, may_meet, readings, sums


def running_cells(events: DataFrame, store: Store, keys: Sequence[str] = (), event_time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Cells of a streaming ``events`` (for ``update`` or ``complete`` output; with ``event_time``
    and ``window``, also ``append``: a window's cells come out when it can't change any more).

    A stream has one aggregation and is read once, so the paths of all fills need the same Columns."""
    keys, fills = list(keys), store.book.fills
    if window:
        events, keys = events.withWatermark(event_time, late), [*keys, event_time]
    reads = readings(fills, keys)
    if len(reads) > 1:
        raise ValueError("the fills of a stream take their paths from the same Columns")
    rows = reads[0].rows(events)
    if may_meet(fills):
        rows = reads[0].named(rows)
        return rows.groupBy(*[F.window(k, window) if window and k == event_time else k for k in keys], *CELL).agg(*sums())
    by = [F.window(c, window).alias(c) if window and i == len(keys) - 1 else F.col(c) for i, c in enumerate(reads[0].by)]
    cells = reads[0].named(rows.groupBy(*by, "cell").agg(*sums()))
    return cells.withColumnRenamed(event_time, "window") if window else cells
