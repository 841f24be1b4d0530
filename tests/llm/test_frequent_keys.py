"""Joins of rows with frequent keys: the same rows however many count as frequent, and few of them in a task."""

import pytest
from pyspark.sql import functions as F

from spanlab.llm import _common, line_dedup


@pytest.mark.parametrize("frequent", [1, 8, 10_000])
def test_same_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(_common, "FREQUENT", frequent)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    side = rows.where("k < 40").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("told", F.col("k") * 7)
    got = _common.joined_by_frequency(rows, side, ["k"], "n", 3000)
    assert got.columns == ["k", "id", "n", "told"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(side, "k").collect()))


def test_frequent_rows_are_not_shuffled(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = _common.joined_by_frequency(rows, side, ["k"], "n", 3000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and got.count() == 3000


@pytest.mark.parametrize("frequent", [1, 10_000])
def test_a_line_in_a_third_of_all_rows(spark, monkeypatch, frequent):
    """Runs of lines between very common ones: the later copies go, whichever way ranks reach their rows."""
    monkeypatch.setattr(_common, "FREQUENT", frequent)
    texts = [(d, "\n".join(["the same", f"only {d}", "the same", "second of a run", "third of a run"])) for d in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_deduplicated(docs).collect()}
    assert got[0].text == texts[0][1] and got[0].n_removed == 0
    assert all(got[d].text == f"the same\nonly {d}" for d in range(1, 60)) and len(got) == 60
