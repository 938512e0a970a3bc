"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """L2-normalised array<double>; a zero vector stays zero.

    The norm is zipped in: named inside the lambda, it would be computed again
    for every element.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
    return F.zip_with(
        vector,
        F.array_repeat(norm, F.size(vector)),
        lambda x, n: F.when(n > 0, x / n).otherwise(0.0),
    )
