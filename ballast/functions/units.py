"""Column helpers for comparable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mm(value: Column | str) -> Column:
    """A length as whole millimetres, so that comparisons don't hang on the last digit."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * 1000 + 0.5).cast("long")


def steady_mean(value: Column | str) -> Column:
    """The mean of doubles, to the last bit the same in whatever order the rows are added; null if all are null, NaN if one isn't finite.

    Each value is cut into whole numbers, multiples of 2^-24 and of 2^-54, whose
    sums are exact (up to 16 million values with a sum of up to 9e15; beyond
    that it is as good as any mean of doubles).
    """
    value = F.col(value) if isinstance(value, str) else value
    whole = F.rint(value)
    middle = F.rint((value - whole) * 2.0**24) / 2.0**24
    fine = F.rint((value - whole - middle) * 2.0**54) / 2.0**54
    return (F.sum(whole) + (F.sum(middle) + F.sum(fine))) / F.count(value)
