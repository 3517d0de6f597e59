"""Column builders over arrays of numbers and 64-bit words."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.masks import bound, total


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_word(v: Column, width: int = 63) -> Column:
    """The signs of the first ``width`` values as bits of a long."""
    bits = F.transform(F.slice(v, 1, width), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("bigint"))
    return F.aggregate(bits, F.expr("0L"), lambda s, x: s + x)


def softmax(v: Column) -> Column:
    raised = bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    share = lambda r: bound(total(r), lambda t: F.transform(r, lambda x: x / t))
    return bound(raised, share)


def top_margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return ordered[0] - ordered[1]


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..1, saturation, value of channels in 0..1; the first of equal channels wins."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d < 1e-10, F.lit(0.0)).when(top == r, (g - b) / (d + 1e-10)).when(top == g, (b - r) / (d + 1e-10) + 2).otherwise((r - g) / (d + 1e-10) + 4)
    return F.pmod(h / 6, F.lit(1.0)), F.when(top > 0, d / (top + 1e-10)).otherwise(0.0), top


def circular_mean(mean_sin: Column, mean_cos: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(mean_sin, mean_cos)), F.lit(360.0))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def warm_up_cosine(epoch: Column, warm: int, total: int, base: float, least: float = 0.0) -> Column:
    """Learning rate of an epoch counted from 1: linear warm-up, then half a cosine."""
    way = (epoch - warm) / float(max(1, total - warm))
    return F.when(epoch <= warm, base * epoch / float(warm)).otherwise(least + 0.5 * (base - least) * (1 + F.cos(F.lit(math.pi) * way)))
