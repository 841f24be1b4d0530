"""Read-side views of metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_worst(rows: DataFrame, column: str, higher_is_better: bool, by: list[str] | None = None) -> DataFrame:
    """Adds best and worst; nulls are neither."""
    whole = Window.partitionBy(*(by or []))
    top, low = F.max(column).over(whole), F.min(column).over(whole)
    best, worst = (top, low) if higher_is_better else (low, top)
    return rows.withColumn("best", F.coalesce(F.col(column) == best, F.lit(False))).withColumn("worst", F.coalesce(F.col(column) == worst, F.lit(False)))


def significance_marks(rows: DataFrame, comparisons: DataFrame) -> DataFrame:
    """rows (strategy, metric) with '*' (p < 0.05) or '**' (p < 0.01) of the first comparison against that strategy."""
    first = comparisons.groupBy(F.col("strategy_b").alias("strategy"), "metric").agg(F.min_by("p_holm", F.struct("model", "strategy_a")).alias("p"))
    mark = F.when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return rows.join(first, ["strategy", "metric"], "left").withColumn("mark", F.coalesce(mark, F.lit(""))).drop("p")


def shared_models(before: DataFrame, after: DataFrame) -> DataFrame:
    """The models that both runs have, which alone can be compared."""
    return before.select("model").intersect(after.select("model"))


def model_pivot(metrics: DataFrame, value: str, models: list[str]) -> DataFrame:
    return metrics.groupBy("strategy").pivot("model", models).agg(F.avg(value))


def size_histogram(chunks: DataFrame, bins: int = 20) -> DataFrame:
    """Equal bins between a strategy's least and greatest chunk size."""
    whole = Window.partitionBy("strategy")
    low, high = F.min("char_count").over(whole), F.max("char_count").over(whole)
    bin_ = F.when(high > low, F.least(F.floor((F.col("char_count") - low) * bins / F.nullif(high - low, F.lit(0))), F.lit(bins - 1))).otherwise(0)
    return chunks.withColumn("bin", bin_.cast("int")).groupBy("strategy", "bin").agg(F.count(F.lit(1)).alias("n"))
