"""User analyses: a class that says, in Columns, what to do with an event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, variants
from ..operators.fill import Store


class Processor:
    """Override ``process``, and what else is wanted. Nothing here runs per event: each hook
    returns expressions, and one job computes all fills of all variants."""

    #: how blocks end up in the output: AUTO keeps the input's, DROP writes none, MANUAL_FORWARD and
    #: MANUAL_BACKWARD write those that ``block_marks`` says, before or after their events
    metadata: str = "AUTO"
    #: columns that order events within a segment, for manual blocks
    segment: Sequence[str] = ()
    order: Sequence[str] = ()
    #: whether results are kept for each block (of ``segment`` and ``block``) or for all events
    per_block: bool = False

    def prepare(self, events: DataFrame) -> DataFrame:
        return events

    def process_new_metadata(self, metadata: DataFrame) -> DataFrame:
        """Blocks as they come; what is returned goes out."""
        return metadata

    def process_end_metadata(self, metadata: DataFrame) -> DataFrame:
        return metadata

    def block_marks(self) -> tuple[Column, Column]:
        """For manual blocks: which events start (or end) one, and the metadata that then goes out."""
        raise NotImplementedError

    def emit(self) -> Column | None:
        """An array of structs: the rows that go out for an event, none or several; instead of ``keep``."""
        return None

    def channels(self) -> Mapping[str, Column]:
        return {}

    def systematics(self) -> Mapping[str, Mapping[str, Column]]:
        return {}

    def process(self, store: Store) -> None:
        raise NotImplementedError

    def keep(self) -> Column | None:
        """Events to write out: those for which it holds in any variant."""
        return None


@dataclass
class Analysis:
    results: DataFrame
    skim: DataFrame | None
    metadata: DataFrame | None


def analyse(processor: Processor, events: DataFrame, metadata: DataFrame | None = None, keys: Sequence[str] = (), plan: str = "once", weight: Column | float = 1.0) -> Analysis:
    events = processor.prepare(events)
    channels, systematics = processor.channels(), processor.systematics()
    blocks_out, keys = None, list(keys)
    if processor.metadata.startswith("MANUAL"):
        mark, about = processor.block_marks()
        events, blocks_out = blocks.manual(events, processor.segment, processor.order, mark, about, processor.metadata == "MANUAL_FORWARD")
    elif metadata is not None and processor.metadata != "DROP":
        blocks_out = processor.process_end_metadata(processor.process_new_metadata(metadata))
    if processor.per_block:
        keys += [c for c in (*processor.segment, "block") if c not in keys]
    rows = variants.fan_out(events, channels, systematics) if channels or systematics else events.withColumn(variants.VARIANT, F.lit(""))
    store = Store(F.col(variants.VARIANT), weight)
    processor.process(store)
    keep, emit = processor.keep(), processor.emit()
    if emit is not None:
        skim = events.select(F.explode(emit).alias("_out")).select("_out.*")
    else:
        skim = None if keep is None else variants.skim_events(events, keep, systematics, channels)
    return Analysis(store.run(rows, plan, keys), skim, blocks_out)


def merge_results(results: DataFrame, key: str) -> DataFrame:
    """Cells of all blocks of one ``key`` added up."""
    from ..operators.results import merge

    return merge(results, keys=[key])


def merge_metadata(metadata: DataFrame, key: str, segment: Sequence[str], order: str) -> DataFrame:
    return blocks.merge_per(metadata, key, segment, order)
