"""Running sums and maxima in an order, over groups of any size.

A window over a group puts the group into one task. Here the rows of a group are dealt into ranges of the order by sampled
splitters (quantile sketches), windows run within the ranges, and what the ranges before add comes from their totals: a
table of at most RANGES rows for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group, and rows below which it has just one.
RANGES = 128
LEAST = 10_000
_HOW = {"sum": F.sum, "max": F.max}


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys in which nulls are equal. right has no other column of left's."""
    there = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(there[f"_{k}_"])
    return left.join(there, on, how).drop(*(f"_{k}_" for k in keys))


def dealt(rows: DataFrame, by: list[str], order: str, ranges: int = RANGES, least: int = LEAST, **sums: str) -> DataFrame:
    """Adds _range: rows of a lower range are before those of a higher one, equals are in one range. order is numeric.
    sums: columns to add, as sums over the whole group of others.

    Nulls are first and in range 0, NaNs last.
    """
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = F.when(F.count(F.lit(1)) > least, F.array_distinct(F.percentile_approx(F.col(order).cast("double"), shares, 20 * ranges)))
    ends = rows.groupBy(*by).agg(cuts.alias("_cuts"), *[F.sum(of).alias(name) for name, of in sums.items()])
    # A large group's rows meet its splitters in as many parts.
    parts = 16
    ends = ends.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    met = same_keys(rows, ends, [*by, "_part"])
    value = F.col(order).cast("double")
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < value))
    return met.withColumn("_range", below).drop("_cuts", "_part")


def before(rows: DataFrame, by: list[str], order: str, **totals: tuple[str, Column | str]) -> DataFrame:
    """rows as `dealt` gives them, each order once in a group. Adds for each total (sum or max, of what) its value over all
    rows before: 0 for a sum and null for a maximum of none."""
    rows = rows.withColumns({f"_{name}": F.col(what) if isinstance(what, str) else what for name, (_, what) in totals.items()})
    here = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "_range").agg(*[_HOW[how](f"_{name}").alias(f"_all_{name}") for name, (how, _) in totals.items()])
    ends = ends.select(*by, "_range", *[_HOW[how](f"_all_{name}").over(earlier).alias(f"_carried_{name}") for name, (how, _) in totals.items()])
    rows = rows.withColumns({f"_own_{name}": _HOW[how](f"_{name}").over(here) for name, (how, _) in totals.items()})
    out = same_keys(rows, ends, [*by, "_range"])
    both = {
        name: F.coalesce(f"_carried_{name}", F.lit(0)) + F.coalesce(f"_own_{name}", F.lit(0)) if how == "sum" else F.greatest(f"_carried_{name}", f"_own_{name}")
        for name, (how, _) in totals.items()
    }
    return out.withColumns(both).drop(*(f"{kind}_{name}" for name in totals for kind in ("", "_own", "_carried")))
