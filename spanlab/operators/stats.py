"""Paired and item statistics: resampling, tests, effect sizes, family-wise correction, sensitivity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from spanlab.functions.numbers import improvement_pct
from spanlab.operators import ranges


#: Cells that a task holds of a group, and places of a table that tells the cell of a drawn index at once.
CELLS = 1 << 20
_PLACES = 1 << 22


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits to other ones, by products that wrap, so any engine can have the same."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(73244475)
    return x ^ (x >> np.uint32(16))


def _drawn(ends: np.ndarray, first: int, n: int, rounds: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Draws of n from n places, of which cells hold [first, ends[0]), [ends[0], ends[1]) and so on. For each round, by parts,
    its position in rounds and the numbers of the cells that are drawn; places of other slices are passed over."""
    bases = _scrambled(((rounds + seed * 1_000_003) % (1 << 32)).astype(np.uint32))
    last = int(ends[-1])
    whole = first == 0 and last == n
    table = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=first)) if last - first <= _PLACES else None
    for at in range(0, n, 1 << 16):
        mixed = _scrambled(np.arange(at + 1, min(at + (1 << 16), n) + 1, dtype=np.uint32))
        for k, base in enumerate(bases):
            picks = _scrambled(base ^ mixed) % np.uint32(n)
            if not whole:
                picks = picks[(picks >= first) & (picks < last)]
            yield k, table[picks - np.uint32(first)] if table is not None else np.searchsorted(ends, picks, "right")


def _cells(items: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Different rows of columns in each group, with how often they stand (n) and in slices of CELLS: first, the place of a
    cell's first item in the order of columns, and total, the group's size."""
    counted = items.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))
    if len(columns) == 1 and isinstance(items.schema[columns[0]].dataType, NumericType):
        ordered = ranges.dealt(counted, by, columns[0], total="n")
        placed = ranges.before(ordered, by, columns[0], first=("sum", "n"), cell=("sum", F.lit(1)))
    else:  # classes and the like: few
        group = Window.partitionBy(*by)
        order = group.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
        sums = {"first": F.sum("n").over(order), "cell": F.sum(F.lit(1)).over(order)}
        placed = counted.withColumns({name: F.coalesce(x, F.lit(0)) for name, x in sums.items()}).withColumn("total", F.sum("n").over(group))
    return placed.select(*by, *columns, "n", "first", "total", F.floor(F.col("cell") / CELLS).alias("slice"))


def _resampled(items: DataFrame, by: list[str], columns: list[str], resamples: int, work, added: str, least: int) -> DataFrame:
    """work(cells, rounds) for each group, slice of its cells and block of rounds: a table with r and more; by is put before.

    A task holds the cells of one slice, whatever the number of items: neither items nor draws are collected or joined.
    """
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(resamples, 4 * tasks)
    cells = _cells(items, by, columns).where(F.col("total") >= least)
    # Small tables of long work: by a fixed number of partitions, which are never put together for their size.
    cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(2 * tasks, *by, "slice", "block")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("first").combine_chunks()
        rounds = np.arange(table.column("block")[0].as_py(), resamples, blocks)
        out = work(table, rounds)
        same = pa.array(np.zeros(len(out), np.int64))
        return pa.Table.from_arrays([*(table.column(c).take(same) for c in by), *out.columns], [*by, *out.column_names])

    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in by)
    return cells.groupBy(*by, "slice", "block").applyInArrow(run, ", ".join(filter(None, (kinds, added))))


def resampled_means(items: DataFrame, by: list[str], value: str, resamples: int, seed: int, least: int = 2) -> DataFrame:
    """The mean of each resample of groups of `least` items or more: by, r, m. Draws are of places in the order of value."""
    told = items.select(*by, F.col(value).cast("double").alias("_value"))

    def work(cells: pa.Table, rounds: np.ndarray) -> pa.Table:
        values, n = cells.column("_value").to_numpy(), cells.column("total")[0].as_py()
        first = cells.column("first")[0].as_py()
        ends = cells.column("first").to_numpy() + cells.column("n").to_numpy()
        sums = np.zeros(len(rounds))
        for k, drawn_ in _drawn(ends, first, n, rounds, seed):
            sums[k] += values[drawn_].sum()
        return pa.table({"r": rounds, "s": sums, "n": np.full(len(rounds), n)})

    parts = _resampled(told, by, ["_value"], resamples, work, "r bigint, s double, n bigint", least)
    return parts.groupBy(*by, "r").agg((F.sum("s") / F.first("n")).alias("m"))


def resampled_counts(items: DataFrame, by: list[str], columns: list[str], resamples: int, seed: int) -> DataFrame:
    """How often each resample has each different row of columns: by, r, columns, n (those it has)."""

    def work(cells: pa.Table, rounds: np.ndarray) -> pa.Table:
        first, n = cells.column("first")[0].as_py(), cells.column("total")[0].as_py()
        ends = cells.column("first").to_numpy() + cells.column("n").to_numpy()
        counts = np.zeros((len(rounds), len(ends)), np.int64)
        for k, drawn_ in _drawn(ends, first, n, rounds, seed):
            counts[k] += np.bincount(drawn_, minlength=len(ends))
        k, cell = np.nonzero(counts)
        return pa.table({"r": rounds[k], **{c: cells.column(c).take(pa.array(cell)) for c in columns}, "n": counts[k, cell]})

    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in columns)
    return _resampled(items.select(*by, *columns), by, columns, resamples, work, f"r bigint, {kinds}, n bigint", 1)


def bootstrap_means(diffs: DataFrame, by: list[str], value: str = "diff", resamples: int = 200, seed: int = 42) -> DataFrame:
    """by, low, high: the 2.5 and 97.5 percentiles (interpolated) of resampled means; null for fewer than two rows."""
    means = resampled_means(diffs, by, value, resamples, seed)
    ends = means.groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return ranges.same_keys(diffs.select(*by).distinct(), ends, by)


def order_statistic_interval(items: DataFrame, by: list[str], value: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """Item bootstrap of a mean: the sorted draws' entries at int(tail * B); a point interval below two items."""
    points = items.groupBy(*by).agg(F.avg(value).alias("point"))
    return _interval(points, resampled_means(items, by, value, resamples, seed), by, resamples)


def _interval(points: DataFrame, means: DataFrame, by: list[str], resamples: int) -> DataFrame:
    sorted_ = means.groupBy(*by).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # resamples entries
    low, high = (F.coalesce(F.get("ms", F.lit(k)), "point") for k in (int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))))
    return ranges.same_keys(points, sorted_, by).select(*by, "point", low.alias("low"), high.alias("high"))


def bootstrap_statistic(items: DataFrame, by: list[str], statistic, columns: list[str], resamples: int = 200, seed: int = 42) -> DataFrame:
    """Item bootstrap of any statistic of a pandas frame of columns (macro-F1, say): by, point, low, high as in
    `order_statistic_interval`. The statistic sees each different row with its column `times`, so that its frame has the
    size of the different rows, not of the items."""

    def frame(counts: pd.DataFrame) -> pd.DataFrame:
        told = counts[columns].assign(times=counts["n"])
        return pd.DataFrame([{**{c: counts[c].iloc[0] for c in [*by, "r"]}, "m": float(statistic(told))}])

    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in by)
    drawn_ = resampled_counts(items, by, columns, resamples, seed)
    means = drawn_.groupBy(*by, "r").applyInPandas(frame, f"{kinds}, r bigint, m double")
    counted = items.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.lit(0).cast("bigint"))
    points = counted.groupBy(*by, "r").applyInPandas(frame, f"{kinds}, r bigint, m double").select(*by, F.col("m").alias("point"))
    return _interval(points, means, by, resamples)


def value_ranks(counted: DataFrame, by: list[str], value: str, out: str, count: str = "n") -> DataFrame:
    """counted: each value of a group once, with how often it stands. Adds its rank from 1; ties share their mean."""
    placed = ranges.before(ranges.dealt(counted, by, value), by, value, _first=("sum", count))
    return placed.withColumn(out, F.col("_first") + (F.col(count) + 1) / 2).drop("_first", "_range")


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, ties share their mean. Values are counted before they are ranked, so ties and groups may be of any size."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return ranges.same_keys(rows, value_ranks(counted, by, value, out, "_n").drop("_n"), [*by, value])


def signed_rank_sums(diffs: DataFrame, by: list[str], value: str = "diff") -> DataFrame:
    """Of each group with differences other than zero: w_plus, w_minus, n_nonzero, and tied, the sum of t^3 - t over ties."""
    some = diffs.where(F.col(value) != 0).withColumn("_abs", F.abs(value))
    counted = some.groupBy(*by, "_abs").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 0).alias("above"))
    placed = value_ranks(counted, by, "_abs", "_rank")
    n, above, rank = F.col("n"), F.col("above"), F.col("_rank")
    size = n.cast("double")
    return placed.groupBy(*by).agg(F.sum(rank * above).alias("w_plus"), F.sum(rank * (n - above)).alias("w_minus"), F.sum(n).alias("n_nonzero"), F.sum(size * size * size - size).alias("tied"))


def signed_ranks(diffs: DataFrame, by: list[str], value: str = "diff") -> DataFrame:
    """Sums of ranks of positive and negative differences (zeros dropped), the rank-biserial correlation, and p_wilcoxon."""
    sums = signed_rank_sums(diffs, by, value)
    out = ranges.same_keys(diffs.select(*by).distinct(), sums, by).fillna(0, ["w_plus", "w_minus", "n_nonzero", "tied"])
    total = F.col("w_plus") + F.col("w_minus")
    out = out.withColumn("rank_biserial", F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / F.nullif(total, F.lit(0.0))).otherwise(0.0))
    return out.withColumn("p_wilcoxon", wilcoxon_p("n_nonzero", "w_plus", "tied")).drop("tied")


def cohens_d(value: Column) -> Column:
    """Paired: mean over sample deviation; 0 for no difference at all, infinite for a constant one."""
    m, s = F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return F.when(s > 0, m / F.nullif(s, F.lit(0.0))).when(m == 0, 0.0).when(m > 0, float("inf")).otherwise(float("-inf"))


def t_statistic(value: Column) -> Column:
    """0 where it isn't a number (no differences)."""
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    return F.when(s > 0, m / F.nullif(s / F.sqrt(n), F.lit(0.0))).when(m == 0, 0.0).when(m > 0, float("inf")).otherwise(float("-inf"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    if math.isnan(t):
        return 1.0
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def wilcoxon_p_value(n: int, plus: float, tied: float) -> float:
    """Two-sided, from the number of differences, the rank sum of positive ones and the sum of t^3 - t over ties; exact up to
    50 untied differences, else normal with the correction for ties."""
    if not n:
        return 1.0
    low = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not tied:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)
    return 1.0 if spread == 0 else min(1.0, math.erfc(abs(low - n * (n + 1) / 4) / spread / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def wilcoxon_p(n: pd.Series, plus: pd.Series, tied: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_p_value(int(a), b, c) for a, b, c in zip(n, plus, tied)])


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, b) for a, b in zip(t, df)])


def holm(rows: DataFrame, p: str, by: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Step-down correction over the whole family, or over each group's. Equal p have equal results; null ones don't count.

    Different p are ranked, not rows: the family may be of any size and is never in one task.
    """
    by = by or []
    counted = rows.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranges.before(ranges.dealt(counted, by, p, _size="_n"), by, p, _first=("sum", "_n"))
    step = placed.withColumn("_step", F.least(F.col(p) * (F.col("_size") - F.col("_first")), F.lit(1.0)))
    highest = ranges.before(step, by, p, _highest=("max", "_step"))
    corrected = highest.select(*by, p, F.greatest("_highest", "_step").alias(out))
    return ranges.same_keys(rows, corrected, [*by, p])


def leave_one_out(diffs: DataFrame, by: list[str], document: str = "document_id", value: str = "diff") -> DataFrame:
    """Mean difference without each document: its least, its greatest, and the document whose absence lowers it most."""
    whole = diffs.groupBy(*by).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    each = diffs.groupBy(*by, document).agg(F.sum(value).alias("sd"), F.count(value).alias("nd")).join(whole, by).where("n - nd >= 2")
    each = each.withColumn("m", (F.col("s") - F.col("sd")) / (F.col("n") - F.col("nd")))
    return whole.select(*by).join(each.groupBy(*by).agg(F.min("m").alias("lodo_min"), F.max("m").alias("lodo_max"), F.min(F.struct("m", F.col(document).alias("d")))["d"].alias("lodo_worst")), by, "left")


def paired(rows: DataFrame, treatments: list[str], metrics: list[str], keys: tuple[str, str] = ("model", "query_id")) -> DataFrame:
    """rows: strategy, keys, metric columns. Differences of every treatment against every other strategy, by metric."""
    unpivoted = rows.unpivot(["strategy", *keys], metrics, "metric", "value")
    a = unpivoted.where(F.col("strategy").isin(treatments)).select(F.col("strategy").alias("strategy_a"), *keys, "metric", F.col("value").alias("a"))
    b = unpivoted.where(~F.col("strategy").isin(treatments)).select(F.col("strategy").alias("strategy_b"), *keys, "metric", F.col("value").alias("b"))
    return a.join(b, [*keys, "metric"]).withColumn("diff", F.col("a") - F.col("b"))


def comparison_matrix(diffs: DataFrame, resamples: int = 200, seed: int = 42, document=None) -> DataFrame:
    """One row for each (model, metric, A, B): means, t, d, corrected p, interval, rank-biserial, sensitivity."""
    by = ["model", "metric", "strategy_a", "strategy_b"]
    out = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("mean_diff"), t_statistic(F.col("diff")).alias("t"), cohens_d(F.col("diff")).alias("cohens_d"))
    out = holm(out.withColumn("p_t", t_p("t", F.col("n") - 1)), "p_t")
    documents = diffs.withColumn("document_id", document if document is not None else F.col("query_id"))
    for part in (bootstrap_means(diffs, by, "diff", resamples, seed), signed_ranks(diffs, by).drop("n_nonzero", "w_plus", "w_minus"), leave_one_out(documents, by)):
        out = out.join(part, by, "left")
    return out.withColumn("significant", F.col("p_holm") < 0.05)


def uncorrected(diffs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The older comparison, for readers of it: a paired t-test for each metric and pair of strategies with two common queries
    or more, uncorrected, with the change of the means in per cent (0 for a mean of 0). `comparison_matrix` takes its place."""
    by = ["model", "metric", "strategy_a", "strategy_b"]
    out = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), t_statistic(F.col("diff")).alias("t"), cohens_d(F.col("diff")).alias("cohens_d"))
    out = out.where("n >= 2").withColumn("improvement_pct", improvement_pct(F.col("mean_a"), F.col("mean_b")))
    return out.withColumn("p", t_p("t", F.col("n") - 1)).withColumn("significant", F.col("p") < alpha)


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """0 for fewer than two rows or a constant side. Sums go over different pairs of values, with how often they stand."""
    pairs = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("n"))
    for side, out in ((x, "_rx"), (y, "_ry")):
        counted = pairs.groupBy(*by, side).agg(F.sum("n").alias("_n"))
        pairs = ranges.same_keys(pairs, value_ranks(counted, by, side, out, "_n").drop("_n"), [*by, side])
    n, a, b = F.col("n"), F.col("_rx"), F.col("_ry")
    sums = pairs.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"),
        F.sum(n * b * b).alias("bb"), ((F.min(a) == F.max(a)) | (F.min(b) == F.max(b))).alias("flat"),
    )
    mean = lambda c: F.col(c) / F.col("n")
    spread = F.sqrt((mean("aa") - mean("a") * mean("a")) * (mean("bb") - mean("b") * mean("b")))
    value = F.when((F.col("n") < 2) | F.col("flat"), 0.0).otherwise((mean("ab") - mean("a") * mean("b")) / F.nullif(spread, F.lit(0.0)))
    return sums.select(*by, value.alias("spearman"))


def seeded_sample(rows: DataFrame, k: int, seed: int, key: str, total: int | None = None) -> DataFrame:
    """k rows by a digest of their key, in the key's order; all of them for k <= 0 or k >= their number."""
    if k <= 0:
        return rows.orderBy(key)
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k).orderBy(key)
