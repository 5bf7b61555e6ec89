"""Streaming histograms: a bounded number of bins (centre, count) that any values can be added to.

A new value is a bin of its own; while there are too many, the two that lie closest become one at
their weighted mean. Histograms of parts merge by adding the bins of one to the other, so each task makes
one of its rows, and only those meet.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Histogram:
    """At most ``size`` bins; knows the least and the largest value that it was given."""

    def __init__(self, size: int, feature: int = 0):
        self.size, self.feature = size, feature
        self.centres: list[float] = []
        self.counts: list[int] = []
        self.low, self.high = float("inf"), float("-inf")

    def update(self, value: float, count: int = 1) -> None:
        self.low, self.high = min(self.low, value), max(self.high, value)
        at = bisect_left(self.centres, value)
        if at < len(self.centres) and self.centres[at] == value:
            self.counts[at] += count
            return
        self.centres.insert(at, value)
        self.counts.insert(at, count)
        if len(self.centres) > self.size:
            gaps = np.diff(self.centres)
            k = int(gaps.argmin())
            total = self.counts[k] + self.counts[k + 1]
            self.centres[k : k + 2] = [(self.centres[k] * self.counts[k] + self.centres[k + 1] * self.counts[k + 1]) / total]
            self.counts[k : k + 2] = [total]

    def merge(self, other: Histogram) -> Histogram:
        out = Histogram(self.size, self.feature)
        for part in (self, other):
            for value, count in zip(part.centres, part.counts, strict=True):
                out.update(value, count)
        out.low, out.high = min(self.low, other.low), max(self.high, other.high)
        return out

    def total(self) -> int:
        return sum(self.counts)

    def sum(self, value: float) -> float:
        """Estimated number of values up to ``value``: between two centres the density is a straight line."""
        if not self.centres or value < self.low:
            return 0.0
        if value >= self.high:
            return float(self.total())
        i = bisect_left(self.centres, value) - 1
        if i < 0:
            return float(self.counts[0])
        if i + 1 == len(self.centres):
            return float(self.total())
        share = (value - self.centres[i]) / (self.centres[i + 1] - self.centres[i])
        here, there = self.counts[i], self.counts[i + 1]
        return sum(self.counts[:i]) + here / 2 + here * share + (there - here) * share * share / 2

    def uniform(self, parts: int) -> list[float]:
        """Values that part the histogram into ``parts`` of equal count; none if it has fewer bins."""
        if parts > len(self.centres):
            return []
        ahead = np.cumsum([0, *self.counts])[:-1] + np.array(self.counts) / 2  # up to each centre
        out = []
        for j in range(1, parts):
            wanted = j * self.total() / parts
            i = min(max(int(np.searchsorted(ahead, wanted)) - 1, 0), len(self.centres) - 2)
            here, rise = self.counts[i], self.counts[i + 1] - self.counts[i]
            rest = max(wanted - ahead[i], 0.0)
            # here * z + rise * z^2 / 2 = rest, in the form that does not cancel
            z = min(2 * rest / (here + np.sqrt(max(here * here + 2 * rise * rest, 0.0))), 1.0)
            out.append(float(self.centres[i] + (self.centres[i + 1] - self.centres[i]) * z))
        return out

    # The text form is the feature, the size and the bins: f;size;centre count,centre count
    def __str__(self) -> str:
        return f"{self.feature};{self.size};" + ",".join(f"{c!r} {n}" for c, n in zip(self.centres, self.counts, strict=True))

    @classmethod
    def parse(cls, text: str) -> Histogram:
        feature, size, bins = text.split(";")
        out = cls(int(size), int(feature))
        for entry in filter(None, bins.split(",")):
            value, count = entry.split(" ")
            out.update(float(value), int(count))
        return out


def _bins(held: dict[tuple, Histogram], by: list[str]) -> pd.DataFrame:
    rows = [(*key, h.low, h.high, h.centres, h.counts) for key, h in held.items()]
    return pd.DataFrame(rows, columns=[*by, "low", "high", "centres", "counts"])


def histograms(rows: DataFrame, by: list[str], *, value: str = "value", weight: str | None = None, size: int = 40) -> DataFrame:
    """(``by``, low, high, centres, counts): a histogram for each group, over ``weight`` (a count) times each value.

    A task holds a histogram of each of its groups, of a bounded size; those of one group meet as one row per task.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    schema = f"{kinds}, low double, high double, centres array<double>, counts array<long>"

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Histogram] = {}
        for batch in batches:
            for (*key, v), n in batch.groupby([*by, "__v"], sort=True)["__n"].sum().items():
                held.setdefault(tuple(key), Histogram(size)).update(float(v), int(n))
            if len(held) * size > 1 << 20:
                yield _bins(held, by)
                held = {}
        yield _bins(held, by)

    def meet(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        whole = Histogram(size)
        for low, high, centres, counts in parts.sort_values(["low", "high"])[["low", "high", "centres", "counts"]].itertuples(index=False):
            part = Histogram(size)
            part.centres, part.counts, part.low, part.high = list(centres), [int(n) for n in counts], low, high
            whole = whole.merge(part)
        return _bins({tuple(key): whole}, by)

    plain = rows.select(*by, F.col(value).cast("double").alias("__v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("__n")).where("__v is not null")
    return plain.mapInPandas(sketch, schema).groupBy(*by).applyInPandas(meet, schema)
