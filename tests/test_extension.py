"""The extension surface: chunkers from SQL, metrics and chunkers of users."""

import random

import pytest
from pyspark.sql import functions as F

from spanlab.operators import chunkers, clause_aware as A, structural as S
from spanlab.sources import table_functions
from tests.test_clause_aware import UK

STRATEGIES = {
    "chunk_fixed_size": (lambda d: chunkers.fixed_size(d, 40), "40"), "chunk_token_window": (lambda d: chunkers.token_window(d, 9, 2), "9, 2"),
    "chunk_sentence_split": (lambda d: chunkers.sentence_split(d, 30), "30"), "chunk_sentence_window": (lambda d: chunkers.sentence_window(d, 3, 2), ""),
    "chunk_recursive_character": (lambda d: chunkers.recursive_character(d, 60, 10), "60, 10"),
    "chunk_clause_aware": (lambda d: A.clause_aware(d, 10, 200, "uk"), "10, 200, 'uk'"),
}


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(6)
    texts = [UK, "", " \n\t ", None, "é" * 100, *("".join(draw.choices("aB.! \n ", k=200)) for _ in range(20))]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document_id int, text string")


@pytest.mark.parametrize("name", STRATEGIES)
def test_sql_gives_the_rows_of_the_frame(spark, docs, name):
    table_functions.register(spark)
    frame, parameters = STRATEGIES[name]
    given = ", ".join(filter(None, ("text", parameters)))
    got = spark.sql(f"SELECT document_id, c.* FROM {{docs}}, LATERAL {name}({given}) c", docs=docs)
    want = frame(docs)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.count() > 0


def test_metrics_of_users(spark):
    clauses = spark.createDataFrame([("d", "1", None, 0, 60, True, True, 60)], "document_id string, identifier string, parent string, g_start int, g_end int, is_top_level boolean, is_leaf boolean, subtree_end int")
    chunks = spark.createDataFrame([("x", "d", 0, 0, 60, 60), ("x", "d", 1, 60, 130, 70)], "strategy string, document_id string, chunk_index int, char_start int, char_end int, char_count int")
    S.register_metric("longest", lambda chunks, clauses: chunks.groupBy(*S.KEYS).agg(F.max("char_count").alias("longest")))
    try:
        row = S.structural_row(chunks, clauses).first()
        assert row.longest == 70 and row.clause_fragmentation == 0.0
    finally:
        del S.METRICS["longest"]
    for name in ("size_cv", "strategy", "not a name"):
        with pytest.raises(ValueError):
            S.register_metric(name, lambda chunks, clauses: chunks)


def test_documents_that_changed_are_errors(spark, docs):
    one = docs.where("document_id = 0")
    told = one.select("document_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
    assert S.unchanged(one, told).select("text").first().text == UK
    for wrong in (told.withColumn("n_chars", F.col("n_chars") + 1), told.withColumn("text_sha256", F.lit("0"))):
        with pytest.raises(Exception, match="StaleError: document 0"):
            S.unchanged(one, wrong).collect()
