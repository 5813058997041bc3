"""Scalar and array functions over probability and feature vectors (MTH1-12); arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column) -> Column:
    """MTH4: the first place of the maximum, from 0."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def margin(a: Column) -> Column:
    """MTH5: highest minus second highest."""
    ordered = F.sort_array(a, asc=False)
    return ordered[0] - ordered[1]


def entropy(a: Column, least: float = 1e-12) -> Column:
    """MTH6."""
    return -total(F.transform(a, lambda p: p * F.log(F.greatest(p, F.lit(least)))))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """MTH7/MTH8: with the maximum taken off first; of log-probabilities with a temperature."""
    shifted = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / total(e)))[0]


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def unit(a: Column) -> Column:
    """MTH9: of length 1; a zero vector stays."""
    return F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]


def floor_bin(p: Column, bins: int = 10) -> Column:
    """MTH10: [lo, hi), the last closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def right_bin(p: Column, bins: int = 10) -> Column:
    """(lo, hi]."""
    return (F.ceil(p * bins) - 1).cast("int")


def population_sd(squares: Column, mean: Column) -> Column:
    """MTH2: from the mean square and the mean."""
    return F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))
