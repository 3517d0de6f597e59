"""Column builders over heat maps: arrays in row order, ``side`` values a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """f of a value that is computed once a row, also where f uses it for every entry of an array."""
    return F.transform(F.array(value), f)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def quantile(v: Column, q: float) -> Column:
    """Linear interpolation between the values' order statistics."""
    at = (F.size(v) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    between = lambda o: F.get(o, low) + (F.get(o, F.ceil(at).cast("int")) - F.get(o, low)) * (at - low)
    return bound(F.array_sort(F.transform(v, lambda x: x.cast("double"))), between)


def hottest(v: Column, q: float) -> Column:
    """Positions of the values at or above the quantile."""
    return bound(quantile(v, q), lambda cut: F.filter(F.transform(v, lambda x, i: F.when(x.cast("double") >= cut, i)), lambda i: i.isNotNull()))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two position sets; two empty ones give null."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def centre_energy(v: Column, side: int, margin: int) -> Column:
    """The share of a map's sum that is further than ``margin`` cells from its border."""
    inner = F.transform(v, lambda x, i: F.when((F.floor(i / side).between(margin, side - 1 - margin)) & ((i % side).between(margin, side - 1 - margin)), x.cast("double")).otherwise(0.0))
    return F.try_divide(total(inner), total(v))


def min_max(v: Column, flat: float = 1e-8) -> Column:
    """Values scaled to 0..1; a flat map becomes zeros."""
    ends = F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))
    return bound(ends, lambda e: F.transform(v, lambda x: F.when(e["high"] - e["low"] < flat, F.lit(0.0)).otherwise((x.cast("double") - e["low"]) / (e["high"] - e["low"]))))


def mean_of(maps: list[Column]) -> Column:
    """The mean of the maps that aren't null, cell by cell; null where none is valid."""
    zero = F.transform(F.coalesce(*maps), lambda x: F.lit(0.0))
    out, n = zero, F.lit(0)
    for m in maps:
        out = F.zip_with(out, F.coalesce(m, zero), lambda s, x: s + x.cast("double"))
        n = n + m.isNotNull().cast("int")
    return F.transform(out, lambda x: x / n)
