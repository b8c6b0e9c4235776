"""Axes of histograms: a value's bin as a Column.

Bin 0 is underflow and bin ``bins + 1`` overflow. On a regular axis a value equal to the upper
end overflows; the bin comes from dividing by the width of a bin, worked out once, which is not
the same on exact edges as scaling by the number of bins. NaN overflows. A null value
is filled as ``default``, the value an absent field reads as.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    bins: int
    low: float
    high: float
    label: str = ""
    default: float = 0.0

    def __post_init__(self):
        if self.bins < 1 or not self.low < self.high:
            raise ValueError(f"an axis needs bins and a positive width: {self}")

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    @property
    def edges(self) -> list[float]:
        return [self.edge(i) for i in range(1, self.bins + 2)]

    def edge(self, bin_: int) -> float:
        """Lower edge of a bin, from 1."""
        return self.low + (bin_ - 1) * self.width

    def bin(self, value: Column) -> Column:
        x = F.coalesce(value.cast("double"), F.lit(float(self.default)))
        inner = (F.floor((x - F.lit(float(self.low))) / F.lit(self.width)) + 1).cast("int")
        return F.when(x < self.low, 0).when(x > self.high, self.bins + 1).otherwise(inner).cast("int")


@dataclass(frozen=True)
class VariableAxis:
    """Bins [e_i, e_i+1) between rising edges."""

    edge_list: tuple[float, ...]
    label: str = ""
    default: float = 0.0

    def __init__(self, edges, label: str = "", default: float = 0.0):
        edges = tuple(float(e) for e in edges)
        if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError("edges must rise")
        object.__setattr__(self, "edge_list", edges)
        object.__setattr__(self, "label", label)
        object.__setattr__(self, "default", default)

    @classmethod
    def log_bins(cls, bins: int, low: float, high: float, label: str = "") -> VariableAxis:
        step = (math.log10(high) - math.log10(low)) / bins
        return cls([10 ** (math.log10(low) + i * step) for i in range(bins + 1)], label)

    @property
    def bins(self) -> int:
        return len(self.edge_list) - 1

    @property
    def low(self) -> float:
        return self.edge_list[0]

    @property
    def high(self) -> float:
        return self.edge_list[-1]

    @property
    def edges(self) -> list[float]:
        return list(self.edge_list)

    def edge(self, bin_: int) -> float:
        return self.edge_list[bin_ - 1]

    def bin(self, value: Column) -> Column:
        x = F.coalesce(value.cast("double"), F.lit(float(self.default)))
        return reduce(lambda a, b: a + b, [F.when(x >= e, 1).otherwise(0) for e in self.edge_list]).cast("int")
