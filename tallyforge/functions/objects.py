"""Operators on the objects (array elements) within one event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def remove_if(objects: Column, test: Test) -> Column:
    return F.filter(objects, lambda o: ~F.coalesce(test(o), F.lit(False)))


def any_of(objects: Column, test: Test) -> Column:
    return F.coalesce(F.exists(objects, test), F.lit(False))


def all_of(objects: Column, test: Test) -> Column:
    return F.coalesce(F.forall(objects, test), F.lit(True))


def sort_key(objects: Column, key: Test) -> Column:
    """Rising by key; equal keys stay as they are."""
    keyed = F.transform(objects, lambda o, i: F.struct(key(o).alias("k"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda s: s["o"])


def max_element(objects: Column, key: Test) -> Column:
    """The object of the largest key, the first of equal ones; null if there is none."""
    keyed = F.transform(objects, lambda o, i: F.struct(key(o).alias("k"), (-i).alias("i"), o.alias("o")))
    return F.array_max(keyed)["o"]


def leading(objects: Column, key: Test, n: int = 1) -> Column:
    """The n-th largest by key, from 1."""
    down = F.reverse(sort_key(objects, key))
    return F.get(down, F.lit(n - 1))


def in_map(mapping: Column, key: Column) -> Column:
    return F.coalesce(F.map_contains_key(mapping, key), F.lit(False))


def total(objects: Column, value: Test) -> Column:
    return F.aggregate(F.transform(objects, value), F.lit(0.0), lambda a, b: a + F.coalesce(b.cast("double"), F.lit(0.0)))


def matched(objects: Column, others: Column, distance: Callable[[Column, Column], Column], cone: float = 0.1) -> Column:
    """Objects that have another one within ``cone``."""
    return F.filter(objects, lambda o: F.exists(others, lambda t: distance(o, t) < cone))


def regional_sum(objects: Column, value: Test, eta: Test, low: float, high: float) -> Column:
    """Negative sum of a momentum component over the objects with low <= |eta| < high."""
    inside = F.filter(objects, lambda o: (F.abs(eta(o)) >= low) & (F.abs(eta(o)) < high))
    return -total(inside, value)


def good_track(pt: Column, eta: Column, pixel_hits: Column, strip_hits: Column) -> Column:
    return (F.abs(pt) >= 15000) & (F.abs(eta) <= 2.5) & (pixel_hits >= 1) & (strip_hits >= 4)


def is_coloured(pdg_id: Column) -> Column:
    """Quarks, the gluon, and numbers below 9999 whose tens digit is 0, as diquarks' is."""
    a = F.abs(pdg_id)
    return (a < 10) | (pdg_id == 21) | ((a < 9999) & (F.floor(a / 10) % 10 == 0))


def is_final(end_vertex: Column) -> Column:
    """Particles that don't end anywhere."""
    return end_vertex.isNull()


def truth_kind(pdg_id: Column, end_vertex: Column, pt: Column, least: float = 5000.0) -> Column:
    """electron, muon or neutrino for final leptons above ``least``; null for all else."""
    kept = (pdg_id > 10) & (pdg_id < 19) & is_final(end_vertex) & ~is_coloured(pdg_id) & (pt > least)
    named = F.when(pdg_id == 11, "electron").when(pdg_id == 13, "muon").when(pdg_id.isin(12, 14, 16, 18), "neutrino")
    return F.when(kept, named)


def field_as_string(value: Column, repeated: bool = False) -> Column:
    """A field as text; repeated values follow each other with nothing between them."""
    return F.concat_ws("", F.transform(value, lambda v: v.cast("string"))) if repeated else value.cast("string")


def str_cat(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def str_printf(template: str, *parts: Column) -> Column:
    """Each ``%x`` takes the next part as text; parts left over are appended."""
    pieces, texts, i = [], list(parts), 0
    while i < len(template):
        if template[i] == "%" and i + 1 < len(template) and texts:
            pieces.append(texts.pop(0).cast("string"))
            i += 2
        else:
            pieces.append(F.lit(template[i]))
            i += 1
    return F.concat(*pieces, *[t.cast("string") for t in texts]) if pieces or texts else F.lit("")
