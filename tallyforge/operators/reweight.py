"""Normalising simulated samples, and putting samples together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_section(xs: Column, k: Column | None = None, filter_: Column | None = None) -> Column:
    for factor in (k, filter_):
        if factor is not None:
            xs = xs * F.coalesce(factor, F.lit(1.0))
    return xs


def sample_weights(samples: DataFrame, xs: DataFrame, lumi: float) -> DataFrame:
    """(sample, simulation, sum_w, event_count) with ``weight``: xs * lumi / sum_w for simulated
    samples, by the event count where there is no sum; 0 without a cross section; 1 for data."""
    sums = F.coalesce(F.when(F.col("sum_w") != 0, F.col("sum_w")), F.col("event_count").cast("double"))
    simulated = F.coalesce(F.try_divide(F.coalesce("xs", F.lit(0.0)) * lumi, sums), F.lit(0.0))
    return samples.join(xs.select("sample", "xs"), "sample", "left").withColumn("weight", F.when(F.col("simulation"), simulated).otherwise(1.0))


def reweight(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells (with ``sample``) times their sample's weight; entries cut to whole numbers. Cells
    that carry a weight already, or samples that repeat, are refused."""
    if "reweighted" in cells.columns:
        raise ValueError("these cells are reweighted already")
    several = F.raise_error(F.concat(F.lit("several weights of sample "), F.col("sample")))
    one = weights.groupBy("sample").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    one = one.select("sample", F.when(F.col("n") == 1, F.col("weight")).otherwise(several.cast("double")).alias("weight"))
    w = F.coalesce("weight", F.lit(0.0))
    scaled = cells.join(one, "sample", "left")
    return scaled.withColumns({"sumw": F.col("sumw") * w, "sumw2": F.col("sumw2") * w * w, "entries": (F.col("entries") * w).cast("long")}).drop("weight").withColumn("reweighted", F.lit(True))


def periods(events: DataFrame, mapping: DataFrame, run: str) -> DataFrame:
    """Events with subperiod and period (its first letter); UNK for runs that aren't mapped."""
    known = mapping.select(F.col("run").alias("_run"), "subperiod")
    joined = events.join(known, events[run] == F.col("_run"), "left").drop("_run")
    sub = F.coalesce("subperiod", F.lit("UNK"))
    return joined.withColumns({"subperiod": sub, "period": F.when(F.col("subperiod").isNull(), "UNK").otherwise(F.substring(sub, 1, 1))})


def effective_luminosity(samples: DataFrame) -> DataFrame:
    """sum_w / (1000 xs k filter)."""
    whole = cross_section(F.col("xs"), F.col("k"), F.col("filter"))
    return samples.withColumn("effective_lumi", F.try_divide(F.col("sum_w"), whole * 1000.0))


def into_sets(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Cells of samples added up into the sets (sample, set_name) they belong to; samples of no
    set are left out."""
    from .fill import CELL

    joined = cells.join(sets.select("sample", "set_name"), "sample")
    return joined.groupBy("set_name", *CELL).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"), F.sum("entries").alias("entries"))


def missing_samples(sets: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples that a set names and that have no counts."""
    return sets.join(samples, "sample", "left_anti")


def split_by_simulation(cells: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data, simulated) cells by what ``samples`` (sample, simulation) says of theirs."""
    kinds = samples.groupBy("sample").agg(F.bool_and("simulation").alias("simulation"), F.count_distinct("simulation").alias("n"))
    mixed = F.raise_error(F.concat(F.lit("data and simulation in sample "), F.col("sample")))
    known = kinds.select("sample", F.when(F.col("n") == 1, F.col("simulation")).otherwise(mixed.cast("boolean")).alias("simulation"))
    both = cells.join(known, "sample")
    return both.where("not simulation").drop("simulation"), both.where("simulation").drop("simulation")


def set_listing(sets: DataFrame) -> DataFrame:
    """Each set's samples, in order, as one text."""
    return sets.groupBy("set_name").agg(F.array_join(F.array_sort(F.collect_set(F.col("sample").cast("string"))), " ").alias("samples"))


def luminosity_table(sets: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each sample of each set: cross section with its factor, events, weights and
    luminosity (null where there are no counts), and the set's whole cross section."""
    known = sets.join(samples.select("sample", "event_count", "sum_w"), "sample", "left")
    whole = F.sum(F.col("xs") * F.col("k")).over(Window.partitionBy("set_name"))
    lumi = F.try_divide(F.col("sum_w"), F.col("xs") * F.col("k") * F.col("filter") * 1000.0)
    return known.select("set_name", "sample", (F.col("xs") * F.col("k")).alias("xs"), "event_count", "sum_w", lumi.alias("lumi"), whole.alias("set_xs"))


def postprocess(cells: DataFrame, samples: DataFrame, xs: DataFrame, sets: DataFrame, lumi: float) -> DataFrame:
    """Cells by sample to cells by set: weighted and added up, in one aggregation. ``cells`` has
    ``sample``, and a row for each cell of it; entries are cut to whole numbers by sample, so cells
    of several runs are merged first (``results.merge`` by sample)."""
    return into_sets(reweight(cells, sample_weights(samples, xs, lumi)).drop("reweighted"), sets)
