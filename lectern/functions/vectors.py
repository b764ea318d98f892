"""Vector expressions over ARRAY<FLOAT>, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """L2-normalised, the norm floored at 1e-6."""
    length = F.greatest(norm(a), F.lit(1e-6))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(dot_ab: Column, norm_a: Column, norm_b: Column) -> Column:
    product = norm_a * norm_b
    return dot_ab / F.when(product == 0, F.lit(1.0)).otherwise(product)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two frames as a share of 255."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return total / F.size(a) / F.lit(255.0)


def average_hash(pixels: Column) -> Column:
    """64 pixels -> 64 bits, first pixel highest: is the pixel above the mean?"""
    mean = F.aggregate(pixels, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(pixels)
    return F.aggregate(
        pixels,
        F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(
            F.when(x.cast("double") > mean, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
