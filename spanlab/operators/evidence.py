"""Evidence scores: how much of the gold evidence do the selected spans cover, and how much of them is evidence?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions.numbers import safe_ratio
from spanlab.operators.spans import merged_intervals
from spanlab.session import held


def scores(queries: DataFrame, selected: DataFrame, gold: DataFrame) -> DataFrame:
    """queries: query_id, answerable. selected: query_id, document_id, char_start, char_end. gold: query_id, document_id,
    g_start, g_end.

    recall is covered / the union of gold, precision covered / selected characters, overlaps between selections counted
    twice in the latter. Both are null for unanswerable queries; abstained tells whether nothing was selected.
    """
    # Both are a few rows for each query, and several branches use them.
    selected, gold = held(selected.select("query_id", "document_id", "char_start", "char_end")), held(gold)
    union = merged_intervals(gold, ["query_id", "document_id"], "g_start", "g_end")
    whole = union.groupBy("query_id").agg(F.sum(F.col("g_end") - F.col("g_start")).alias("gold_chars"))
    chosen = selected.groupBy("query_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("selected_chars"), F.count(F.lit(1)).alias("n_selected"))
    cut = selected.join(union, ["query_id", "document_id"]).select("query_id", "document_id", F.greatest("char_start", "g_start").alias("char_start"), F.least("char_end", "g_end").alias("char_end")).where("char_end > char_start")
    covered = merged_intervals(cut, ["query_id", "document_id"]).groupBy("query_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("covered_chars"))
    out = queries.join(whole, "query_id", "left").join(chosen, "query_id", "left").join(covered, "query_id", "left").fillna(0, ["gold_chars", "selected_chars", "n_selected", "covered_chars"])
    return out.withColumn("recall", F.when(F.col("answerable"), safe_ratio(F.col("covered_chars"), F.col("gold_chars")))).withColumn("precision", F.when(F.col("answerable"), safe_ratio(F.col("covered_chars"), F.col("selected_chars")))).withColumn("abstention_correct", F.when(F.col("answerable"), F.col("n_selected") > 0).otherwise(F.col("n_selected") == 0))


def resolved(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """queries: query_id, evidence_ids. The spans that a query's identifiers stand for; unknown ones have none."""
    return queries.select("query_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id")


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over the queries they apply to; null where there are none."""
    return rows.groupBy(*by).agg(
        F.count_if("answerable").alias("answerable_n"),
        F.avg("recall").alias("mean_recall"),
        F.avg("precision").alias("mean_precision"),
        F.count_if(~F.col("answerable")).alias("unanswerable_n"),
        F.avg(F.when(~F.col("answerable"), F.col("abstention_correct").cast("double"))).alias("abstention_accuracy"),
    )


def deltas(summaries: DataFrame, reference: str) -> DataFrame:
    """Each strategy against the reference one, with an outcome."""
    base = summaries.where(F.col("strategy") == reference).select(F.col("mean_recall").alias("r0"), F.col("mean_precision").alias("p0"), F.lit(1).alias("_one"))
    rows = summaries.where(F.col("strategy") != reference).withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one", "left")
    rows = rows.withColumn("recall_delta", F.col("mean_recall") - F.col("r0")).withColumn("precision_delta", F.col("mean_precision") - F.col("p0"))
    r, p = F.col("recall_delta"), F.col("precision_delta")
    outcome = F.when(r.isNull() | p.isNull(), "not_comparable").when((r == 0) & (p == 0), "tie").when((r >= 0) & (p >= 0), "win").when((r <= 0) & (p <= 0), "loss").otherwise("mixed")
    return rows.select("strategy", "recall_delta", "precision_delta", outcome.alias("outcome"))
