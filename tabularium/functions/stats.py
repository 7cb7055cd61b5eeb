"""Statistics that Spark's own functions give in another form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(c: Column) -> Column:
    """Sample skewness G1; null for fewer than three values or none that differ."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(c))


def adjusted_kurtosis(c: Column) -> Column:
    """Excess kurtosis G2; null for fewer than four values or none that differ."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1 on, to about 1e-11: the series at n + 8 less the reciprocals on the way there."""
    x = n + 8.0
    square = x * x
    series = F.ln(x) - 0.5 / x - (1 / 12 - (1 / 120 - (1 / 252 - 1 / 240 / square) / square) / square) / square
    return series - reduce(lambda a, b: a + b, [1.0 / (n + float(i)) for i in range(8)])
