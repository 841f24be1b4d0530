"""Number expressions with the evaluation's conventions for empty cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(default).cast("double"))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def poisoned_mean(x: Column) -> Column:
    """Null if any is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))


def size_variation(x: Column) -> Column:
    """Population coefficient of variation, 0 for fewer than two or a zero mean."""
    return F.when((F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0)))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def improvement_pct(new: Column, old: Column) -> Column:
    return F.when(old > 0, (new - old) / F.nullif(old, F.lit(0.0)) * 100).otherwise(0.0)
