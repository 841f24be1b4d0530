"""Classification scores, calibration, and three classifiers: keywords, majority, TF-IDF with logistic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions.numbers import safe_ratio
from spanlab.functions.text import word_tokens

OUT_OF_SCOPE = "__out_of_scope__"


def mapped(items: DataFrame, label_map: DataFrame, label: str = "source_label") -> DataFrame:
    """Source labels to targets by a small dimension; the out-of-scope ones stay marked. Labels that it lacks have no row:
    `unmapped` counts those."""
    return items.join(label_map, label)  # as small as it is it is broadcast by its size


def unmapped(items: DataFrame, label_map: DataFrame, label: str = "source_label") -> DataFrame:
    """Labels, null included, that the dimension lacks, with the number of their items (n)."""
    lost = items.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return lost.join(label_map.select(label), label, "left_anti")


def in_scope(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("target") != OUT_OF_SCOPE)


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.avg((F.col("gold") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1, support and predicted count of each gold label, from confusion counts."""
    return _classes(rows.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n")), by).drop("hit")


def _classes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, gold, pred, n."""
    support = pairs.groupBy(*by, F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    predicted = pairs.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = support.join(predicted, [*by, "label"], "left").fillna(0, ["predicted"])
    out = out.withColumn("precision", safe_ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", safe_ratio(F.col("hit"), F.col("support")))
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_system(items: DataFrame, by: list[str], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """All scores of a system in one row: n, accuracy and macro-F1 with intervals of an item bootstrap, calibration error, and
    as arrays its classes, most frequent confusions and calibration bins. items: by, item_id, gold, pred, confidence.

    Resamples are drawn from the counts of (gold, pred), so neither items nor draws are shuffled.
    """
    from spanlab.operators.stats import resampled_counts

    pairs = resampled_counts(items, by, ["gold", "pred"], resamples, seed)
    each = _classes(pairs, [*by, "r"]).groupBy(*by, "r").agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    sorted_ = each.groupBy(*by).agg(F.sort_array(F.collect_list("accuracy")).alias("a"), F.sort_array(F.collect_list("macro_f1")).alias("f"))  # resamples entries
    low, high = F.lit(int(0.025 * resamples)), F.lit(min(resamples - 1, int(0.975 * resamples)))
    ends = sorted_.select(*by, F.get("a", low).alias("accuracy_low"), F.get("a", high).alias("accuracy_high"), F.get("f", low).alias("macro_f1_low"), F.get("f", high).alias("macro_f1_high"))
    held = lambda rows, order, name: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))
    parts = [macro_f1(items, by), ends, calibration_error(items, by), held(per_class(items, by), ["label", "support", "predicted", "precision", "recall", "f1"], "classes")]
    parts += [held(confusion_top(items, by), ["place", "gold", "pred", "n"], "confusions"), held(calibration(items, by), ["bin", "mean_confidence", "bin_accuracy", "n"], "bins")]
    out = accuracy(items, by)
    for part in parts:
        out = out.join(part, by, "left")
    return out


def macro_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    return per_class(rows, by).groupBy(*by).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def confusion_top(rows: DataFrame, by: list[str], top: int = 15) -> DataFrame:
    wrong = rows.where("gold <> pred").groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "gold", "pred")
    return wrong.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def calibration(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Bins that hold something: mean confidence, accuracy, count, and the bin's share of the calibration error."""
    conf = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("_c", conf).withColumn("bin", F.least(F.floor(F.col("_c") * bins), F.lit(bins - 1)).cast("int"))
    out = rows.groupBy(*by, "bin").agg(F.avg("_c").alias("mean_confidence"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("bin_accuracy"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ece_part", F.col("n") / F.sum("n").over(Window.partitionBy(*by)) * F.abs(F.col("mean_confidence") - F.col("bin_accuracy")))


def calibration_error(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error, and whether accuracy never falls from bin to bin."""
    held = calibration(rows, by, bins)
    before = F.lag("bin_accuracy").over(Window.partitionBy(*by).orderBy("bin"))
    return held.withColumn("_down", F.coalesce(F.col("bin_accuracy") < before, F.lit(False))).groupBy(*by).agg(F.sum("ece_part").alias("ece"), (~F.bool_or("_down")).alias("monotone"))


def majority(rows: DataFrame, label: str = "gold") -> DataFrame:
    """The most frequent label (ties: the smallest), one row."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("label")))["label"].alias("majority"))


def keyword_predictions(items: DataFrame, keywords: DataFrame, fallback: str, id_col: str = "item_id") -> DataFrame:
    """keywords: token, target, weight. The target with the largest weight sum; confidence from its margin."""
    tokens = items.select(id_col, F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("token"))
    sums = tokens.join(F.broadcast(keywords), "token").groupBy(id_col, "target").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy(id_col).orderBy(F.desc("w"), "target")
    best = sums.withColumn("r", F.row_number().over(order)).groupBy(id_col).agg(F.max(F.when(F.col("r") == 1, F.col("target"))).alias("pred"), F.max(F.when(F.col("r") == 1, F.col("w"))).alias("w1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("w"))), F.lit(0.0)).alias("w2"))
    out = items.join(best, id_col, "left")
    return out.withColumn("confidence", F.coalesce(safe_ratio(F.col("w1") - F.col("w2"), F.col("w1")), F.lit(0.0))).withColumn("pred", F.coalesce("pred", F.lit(fallback))).drop("w1", "w2")


def tfidf_regression(train: DataFrame, seed: int = 0, vocabulary: int = 200_000, min_df: float = 2.0):
    """1-2-gram TF-IDF (1 + log tf) with multinomial logistic regression. train: text, label (a number). Returns the model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="one", pattern="[^\\p{L}\\p{N}_]+"),
            NGram(n=2, inputCol="one", outputCol="two"),
            SQLTransformer(statement="SELECT *, concat(one, two) AS grams FROM __THIS__"),
            CountVectorizer(inputCol="grams", outputCol="counts", minDF=min_df, vocabSize=vocabulary),
            IDF(inputCol="counts", outputCol="idf"),
            Normalizer(inputCol="idf", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=1e-3, maxIter=50),
        ]
    ).fit(train)
