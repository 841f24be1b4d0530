"""Places where an operator once did less than its whole job."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.llm import mixing, neighbours, toxicity


def test_small_sources_get_their_words(spark):
    source = F.when(F.col("id") % 200 == 0, "c").when(F.col("id") % 200 < 4, "b").otherwise("a")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), F.lit(30) + (F.col("id") % 21).cast("int")), " ").alias("text"), source.alias("source"))
    rows = mixing.mixed(docs, shards=16, blocks=2000)
    got = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    block = -(-sum(r.target for r in got) // 2000)
    assert len(got) == 3 and all(abs(r.taken - r.target) <= block and r.over <= 0 for r in got), got


def test_clearing_known_words_changes_no_score(monkeypatch):
    texts = ["an idiot here", "many new words that fill the set", "idiot with other words", "some more words, idiot", "plain"]
    how = ({"=idiot": 12.0},)
    want = [toxicity.Field(*how).tagged([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "_KNOWN_WORDS", 3)
    got = toxicity.Field(*how).tagged(texts)
    assert got == want and got[2][1] and got[3][1]


def test_queries_of_small_parts_get_all_neighbours(spark, monkeypatch):
    sides = neighbours.Router(np.zeros(2), 1.0, np.array([[1, -1], [0, 0]], "float32"), np.zeros(2, "float32"), np.eye(2, dtype="float32"), np.zeros(2, "float32"), 1)
    monkeypatch.setattr(neighbours, "train_router", lambda *_: sides)
    docs = spark.createDataFrame([(i, [5.0 if i < 4 else -5.0, float(i)]) for i in range(34)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(docs).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [*range(1, 11)] and [r.rank for r in got] == [*range(1, 11)]


SIZES_SQL = r"""
 WITH RECURSIVE sized AS (SELECT doc_id, doc_id % 20 AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
 s AS (SELECT source, sum(size) AS source_size, CASE (row_number() OVER (ORDER BY source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sized GROUP BY source),
 -- Each round fills the sources that their share would overfill, and shares what is left among the others.
 fill AS (SELECT 0 AS round, source, source_size, weight, NULL::DOUBLE AS target FROM s
          UNION ALL
          SELECT round + 1, source, source_size, weight,
                 CASE WHEN target IS NOT NULL THEN target
                      WHEN weight * (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0)) / sum(weight) FILTER (WHERE target IS NULL) OVER () >= 2 * source_size
                      THEN 2 * source_size END
          FROM fill WHERE round < 20),
 last AS (FROM fill WHERE round = 20),
 shared AS (SELECT source, source_size, coalesce(target, weight * (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0)) / sum(weight) FILTER (WHERE target IS NULL) OVER ()) AS target FROM last)
 SELECT doc_id, size, source_size, round(target, 3) AS target FROM sized JOIN shared USING (source) ORDER BY doc_id"""


@pytest.mark.parametrize("blocks", [500, 2000, 1_000_000])
def test_mix_of_twenty_sources_meets_every_target(spark, blocks):
    """Whatever the number of blocks; sizes and targets are those of the SQL."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).withColumn("source", F.col("doc_id") % 20)
    got = mixing.mixed(docs, blocks=blocks).toPandas()
    by = got.groupby("source").agg({"taken": "sum", "target": "first"})
    assert (abs(by.taken / by.target - 1) < 0.02).all(), by
    assert (got.taken <= 2 * got["size"]).all()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    want = con.sql(SIZES_SQL).fetchall()
    own = got.sort_values("doc_id")[["doc_id", "size", "source_size", "target"]].values.tolist()
    assert [[*row[:3], round(row[3], 3)] for row in own] == [[*map(float, row)] for row in want]


def test_sainte_lague_gives_seats_to_the_highest_quotients(spark):
    rng = np.random.default_rng(1)
    for k, seats in ((1, 7), (5, 3), (40, 12), (40, 1000), (200, 150)):
        votes = (rng.pareto(1.0, k) * 100).astype(int).tolist()
        parts = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "part int, votes double")
        got = {r.part: r.seats for r in mixing.apportioned(parts, "part", "votes", F.lit(seats), [], "seats").collect()}
        want = dict.fromkeys(range(k), 0)
        for _, i in sorted((-v / (2 * s + 1), i) for i, v in enumerate(votes) if v for s in range(seats))[:seats]:
            want[i] += 1
        assert got == want


def test_mixture_of_repeated_identifiers(spark):
    """The same identifier in two sources, twice with another text, and twice in every column."""
    rows = [(7, "one two three", "s1", 1), (7, "four five six", "s2", 2), (8, "a b c d", "s2", 3), (8, "e f g h", "s2", 4), (9, "x y", "s3", 5), (9, "x y", "s3", 5), (None, "n", None, 6)]
    rows += [(i, "w " * i, "s1", i) for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    due = mixing.mixed(docs.drop("size")).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    got = mix.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()
    assert sorted((r.source or "", r.n) for r in got) == sorted((r.source or "", r.n) for r in due if r.n)
    assert sorted(mix.collect(), key=str) == sorted(mixing.mixture(docs).collect(), key=str)
    texts = {r.text for r in mix.where("doc_id = 7 and source = 's2'").collect()}
    assert texts <= {"four five six", "four", "four five", " five six", " six", " five"}
