"""Containment of labelled spans in chunks, against what a grid of the same length would contain; structure recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touched_histogram(rows: DataFrame, top: int = 4) -> DataFrame:
    """rows with touched: spans by the number of chunks that they touch, the last bucket open."""
    return rows.groupBy(F.least(F.col("touched"), F.lit(top)).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def lift(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of contained spans, what a grid of the chunks' mean length would contain, and their difference."""
    mean = chunks.agg(F.avg(F.col("char_end") - F.col("char_start")).alias("_mean"))
    expected = F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("g_end") - F.col("g_start"), F.col("_mean")))
    out = rows.join(F.broadcast(mean)).agg(F.avg(F.col("contained").cast("double")).alias("containment"), F.avg(expected).alias("expected"))
    return out.withColumn("lift", F.col("containment") - F.col("expected"))


def structure_recall(clauses: DataFrame, least: int) -> DataFrame:
    """How many documents show `least` top-level nodes, or nodes of any level; with single-node ones, mean and median."""
    return _recall(clauses.groupBy("document_id").agg(F.count_if("is_top_level").alias("tops"), F.count(F.lit(1)).alias("nodes")), least)


def _recall(counts: DataFrame, least: int) -> DataFrame:
    return counts.agg(F.count_if(F.col("tops") >= least).alias("enough_top"), F.count_if(F.col("nodes") >= least).alias("enough_any"), F.count_if(F.col("nodes") == 1).alias("single"), F.avg("nodes").alias("mean_nodes"), F.median("nodes").alias("median_nodes"))


def compare_profiles(docs: DataFrame, least: int, profiles: tuple[str, ...] = ("uk", "us", "eu")) -> DataFrame:
    """Structure recall of the same documents under the numbering of each jurisdiction: a large gap tells of numbering that one
    profile knows and another doesn't, none of texts without structure. Documents without a clause count with 0 nodes."""
    from spanlab.operators.clause_aware import STYLES, US_ARTICLE
    from spanlab.operators.extract import clause_table, extracted

    us = F.when(F.col("text").rlike(US_ARTICLE), "us_article_section").otherwise("us_section_decimal")
    out = None
    for profile in profiles:
        found = extracted(docs.withColumn("numbering_style", us if profile == "us" else F.lit(STYLES[profile])))
        nodes = clause_table(found).groupBy("document_id").agg(F.count_if("is_top_level").alias("tops"), F.count(F.lit(1)).alias("nodes"))
        counts = docs.select("document_id").join(nodes, "document_id", "left").fillna(0, ["tops", "nodes"])
        row = _recall(counts, least).withColumn("profile", F.lit(profile))
        out = row if out is None else out.unionByName(row)
    return out


def failures(rows: DataFrame) -> DataFrame:
    """Rows whose chunker reported an error instead of raising, by strategy and kind."""
    return rows.where("error is not null").groupBy("strategy", F.col("error").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
