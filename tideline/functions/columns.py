"""Column helpers: division without errors, NaN as null, and names of states."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..models.states import state_name


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def null_nan(x: Column) -> Column:
    """x with NaN as null; panels never hold NaN."""
    return F.nanvl(x, F.lit(None).cast("double"))


def state_label(rank: Column, n: int = 3) -> Column:
    """The name of a state's severity rank; null for null and unknown ranks."""
    out = F.lit(None).cast("string")
    for k in range(n):
        out = F.when(rank == k, state_name(k, n)).otherwise(out)
    return out


def normal_cdf(z: Column, terms: int = 120) -> Column:
    """The standard normal's distribution function, to double precision, without leaving the JVM: 1/2 + phi(z) (z + z^3/3 + z^5/15 + ...); beyond 8 deviations 0 or 1."""
    step = lambda acc, k: F.struct((acc["total"] + acc["term"] * z * z / (2.0 * k + 1)).alias("total"), (acc["term"] * z * z / (2.0 * k + 1)).alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(z.cast("double").alias("total"), z.cast("double").alias("term")), step, lambda acc: acc["total"])
    return F.when(z.isNull() | F.isnan(z), None).when(z > 8, 1.0).when(z < -8, 0.0).otherwise(0.5 + F.exp(-z * z / 2) / (2 * pi) ** 0.5 * series)


def year_fraction(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)
