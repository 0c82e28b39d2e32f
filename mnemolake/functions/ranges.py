"""Where a value lies among sorted bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(value: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds (literals) lie below a value: a binary search in one expression, for any number of bounds. Null gives 0."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    edges = F.array(*bounds)
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])

    def halve(lo: Column, step: Column) -> Column:
        # an index past the end reads null, which lies below nothing
        return F.when(F.coalesce(F.try_element_at(edges, lo + step) < value, F.lit(False)), lo + step).otherwise(lo)

    return F.aggregate(steps, F.lit(0), halve)
