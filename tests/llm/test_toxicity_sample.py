"""What the toxicity fit learns from: its bounds hold for overlong texts and repeated rows, and no row shuts out those after it."""

import pytest
from pyspark.sql import functions as F

from spanlab.llm.toxicity import toxicity, training_rows

SF = "/root/testdata/sf0.01"


def sampled(docs, labels, sample_docs=5000, sample_bytes=1 << 20):
    return training_rows(docs, labels, F.lit(True), "doc_id", "text", "doc_id", "toxic", sample_docs, sample_bytes, 9)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))


def test_an_overlong_text_is_left_out_alone(spark, labels):
    for long in range(0, 200, 17):  # wherever it stands in the order of the hash
        docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") == long, F.repeat(F.lit("x"), 2000)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
        rows = sampled(docs, labels, sample_bytes=1000)
        assert len(rows) == 199 and max(len(t) for t, _ in rows) < 10


def test_bounds_hold_for_bytes_and_repeated_rows(spark, labels):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 10), F.col("id").cast("string")).alias("text"))
    rows = sampled(docs, labels, sample_bytes=1000)
    assert 900 < sum(len(t) for t, _ in rows) <= 1000
    assert len(sampled(docs, labels, sample_docs=50)) == 50
    same_text = docs.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("again").alias("text")))
    own_texts = docs.unionByName(spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text")))
    for many in (same_text, own_texts):
        assert len(sampled(many, labels, sample_docs=50)) == 50
    assert sampled(same_text, labels) != [] and len(sampled(same_text, labels)) == 201
    both = labels.unionByName(labels.select("doc_id", (1 - F.col("toxic")).alias("toxic")))
    assert len(sampled(docs, both)) == 400  # labels that contradict each other both count


def test_scores_with_an_overlong_labelled_text(spark):
    """A labelled text beyond the bound leaves the scores of the others as they are."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    first = labels.where("crc32(cast(doc_id as string)) % 5 <> 0").orderBy(F.xxhash64("doc_id", F.lit(9))).first().doc_id
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("filler "), 400_000)).otherwise(F.col("text")))
    plain = toxicity(docs, labels, sample_bytes=2 << 20).where(F.col("doc_id") != first).agg(F.sum("predicted"), F.max("score")).first()
    odd = toxicity(longer, labels, sample_bytes=2 << 20).where(F.col("doc_id") != first).agg(F.sum("predicted"), F.max("score")).first()
    assert odd[0] > 0 and odd[1] > 0.5 and abs(odd[0] - plain[0]) <= 2
