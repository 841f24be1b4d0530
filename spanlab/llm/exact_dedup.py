"""Exact deduplication by content sort, in DataFrame functions only.

Sampled splitters range-partition the documents by the leading bytes of their normalised text, then its digest, then a
hash of the identifier; each range is sorted, which places equal texts next to each other, and every row compares its
whole text with its neighbour's. A large group of copies is itself cut by splitters, so it fills several ranges; the runs
at the ranges' edges, two for each range at most, are then joined up by digest and whole text.

Defined cases: a null text is the empty text, and all empty texts are copies of each other. A null identifier sorts below
every other. Of rows that repeat both identifier and text one stays. An empty table gives an empty result. Other columns,
whatever their names, are carried untouched by `exact_deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm._common import range_bucket, shuffle_partitions, splitters, written

#: Ranges for each shuffle partition, so that hashing ranges to partitions evens out; and the least rows a range has.
RANGES_PER_PARTITION, LEAST_ROWS = 16, 64


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, normalize: Callable[[Column], Column] | None, payload: bool) -> DataFrame:
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    norm = F.coalesce(docs[text_col], F.lit(""))
    norm = F.coalesce(normalize(norm), F.lit("")) if normalize else norm
    body = docs.select(docs[id_col].alias("id"), norm.alias("norm"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if payload else []))
    body = body.withColumn("digest", F.sha2(F.encode("norm", "UTF-8"), 256))
    lead = F.rpad(F.hex(F.substring(F.encode("norm", "UTF-8"), 1, 8)), 16, "0")
    body = body.withColumn("group_key", F.concat(lead, F.col("digest")))
    body = body.withColumn("key", F.concat("group_key", F.lpad(F.hex(F.xxhash64("id")), 16, "0")))
    rows = docs.count()
    ranges = max(1, min(rows // LEAST_ROWS, RANGES_PER_PARTITION * shuffle_partitions(spark)))
    found = splitters(body, "key", rows, ranges)
    body = body.withColumn("bucket", range_bucket(F.col("key"), found))
    if found:
        around = F.split(F.lit(",".join(found)), ",")
        at_edge = lambda i: F.coalesce(F.substring(F.try_element_at(around, i), 1, 80) == F.col("group_key"), F.lit(False))
        edge = (F.col("bucket") > 0) & at_edge(F.greatest(F.col("bucket"), F.lit(1))) | at_edge(F.col("bucket") + 1)
    else:
        edge = F.lit(False)
    order = Window.partitionBy("bucket").orderBy("group_key", "norm", "key")
    heads = body.withColumn("head", ~F.col("norm").eqNullSafe(F.lag("norm").over(order))).withColumn("edge", edge)
    heads = heads.withColumn("run", F.sum(F.col("head").cast("int")).over(order))
    heads = heads.withColumn("edge_norm", F.when(F.col("edge"), F.col("norm")))
    within = Window.partitionBy("bucket", "run")
    best = F.max("id") if keep == "largest" else F.min("id")
    ranked = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    runs = heads.drop("norm").withColumn("run_keep", best.over(within)).withColumn("run_size", F.count(F.lit(1)).over(within))
    runs = runs.withColumn("nth", F.row_number().over(within.orderBy(ranked)))
    if payload:
        runs = runs.where("nth = 1")
    runs = runs.withColumn("edge_norm", F.when(F.col("nth") == 1, F.col("edge_norm")))
    runs = written(runs.select("id", "digest", "bucket", "run", "edge", "edge_norm", "run_keep", "run_size", "nth", *(["row"] if payload else [])), "exact-dedup")
    firsts = runs.where("edge and nth = 1").select("bucket", "run", "digest", "edge_norm", "run_keep", "run_size")
    best = F.max("run_keep") if keep == "largest" else F.min("run_keep")
    joined = firsts.groupBy("digest", "edge_norm").agg(best.alias("all_keep"), F.sum("run_size").alias("all_size"))
    stitched = firsts.join(joined, ["digest", "edge_norm"]).select("bucket", "run", "all_keep", "all_size", F.lit(True).alias("stitched"))
    # Two runs a range at most are at its edges, and the number of ranges is bounded above: this side stays small.
    out = runs.join(F.broadcast(stitched) if 2 * ranges <= 1_000_000 else stitched, ["bucket", "run"], "left")
    keep_id = F.when(F.col("stitched"), F.col("all_keep")).otherwise(F.col("run_keep"))
    out = out.withColumn("keep_id", keep_id).withColumn("group_size", F.coalesce("all_size", "run_size"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each document: its identifier, keep_id, group_size, kept and text_sha256 of the normalised text."""
    out = _decided(docs, id_col, text_col, keep, normalize, payload=False)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def exact_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    out = _decided(docs, id_col, text_col, keep, normalize, payload=True).where("kept")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
