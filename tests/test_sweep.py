"""Sweeps over spans and hierarchies of any depth, against plain versions and on large documents."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from spanlab.operators import spans, sweep


def random_spans(seed, documents=12, most=40, width=60):
    draw = random.Random(seed)
    rows = []
    for d in [None, *range(documents)]:
        for k in range(draw.randrange(most)):
            a = draw.randrange(width)
            rows.append((d, k, a, draw.choice([a, a + draw.randrange(8), a + draw.randrange(width), a - 1, None])))
    return rows


@pytest.mark.parametrize("least", [1, 4])
def test_overlap_join_against_pairs(spark, least):
    left, right = random_spans(1), random_spans(2)
    a = spark.createDataFrame(left, "document_id int, i int, char_start int, char_end int").repartition(5)
    b = spark.createDataFrame(right, "document_id int, j int, g_start int, g_end int")
    want = {
        (d, i, j, min(e, h) - max(s, g)) for d, i, s, e in left for c, j, g, h in right
        if d is not None and d == c and e is not None and h is not None and e > s and h > g and min(e, h) - max(s, g) >= least
    }
    got = [tuple(r) for r in spans.overlap_join(a, b, least).select("document_id", "i", "j", "overlap_chars").collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_pairs_come_in_bounded_batches():
    starts = np.arange(100)
    batches = list(sweep.overlapping((starts, starts + 50), (starts, starts + 50), pairs=64))
    assert sum(len(i) for i, _ in batches) == sum(1 for a in range(100) for b in range(100) if abs(a - b) < 50)
    assert max(len(i) for i, _ in batches) <= 100


def test_containment_against_pairs(spark):
    chunks, gold = random_spans(3), [(d, k, a, b) for d, k, a, b in random_spans(4) if d is not None]
    a = spark.createDataFrame(chunks, "document_id int, i int, char_start int, char_end int")
    b = spark.createDataFrame(gold, "document_id int, j int, g_start int, g_end int")
    got = {(r.document_id, r.j): (r.contained, r.touched) for r in spans.containment(b, a, ["document_id"]).collect()}
    for d, j, g, h in gold:
        own = [(s, e) for c, _, s, e in chunks if c == d and e is not None and e >= s]
        inside = h is not None and any(s <= g and h <= e for c, _, s, e in chunks if c == d and e is not None)
        assert got[d, j] == (inside, sum(min(e, h) > max(s, g) for s, e in own) if h is not None and h > g else 0), (d, j)


def test_point_in_span_against_pairs(spark):
    points = [(d, i, a) for d, i, a, _ in random_spans(5)]
    held = random_spans(6)
    a = spark.createDataFrame(points, "document_id int, i int, ref_start int")
    b = spark.createDataFrame(held, "document_id int, j int, char_start int, char_end int")
    got = sorted((r.document_id, r.i, r.j) for r in spans.point_in_span(a, b).collect())
    assert got == sorted((d, i, j) for d, i, p in points for c, j, s, e in held if d is not None and d == c and e is not None and s <= p < e)


def test_clashing_columns_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, 5)], "document_id int, char_start int, char_end int")
    with pytest.raises(ValueError):
        spans.overlap_join(rows, rows.withColumns({"g_start": F.col("char_start"), "g_end": F.col("char_end")}))


@pytest.mark.parametrize("rows_a_batch", [1, 3, 7, 1000])
def test_documents_stay_whole(rows_a_batch):
    keys = [k for k, n in enumerate([1, 9, 2, 1, 30, 4]) for _ in range(n)]
    table = pa.table({"k": keys, "v": list(range(len(keys)))})
    batches = table.to_batches(rows_a_batch)
    out = list(sweep.whole_documents(iter(batches), 1))
    assert pa.Table.from_batches(out).equals(table)
    seen = [set(b.column("k").to_pylist()) for b in out]
    assert sum(map(len, seen)) == len(set(keys))


def test_one_large_document(spark):
    """A million spans of one document in seconds: pairs, containment and points grow with the document, not its square."""
    n = 1_000_000
    chunks = spark.range(n).select(F.lit(1).alias("document_id"), F.col("id").alias("i"), (F.col("id") * 7).alias("char_start"), (F.col("id") * 7 + 10).alias("char_end"))
    gold = spark.range(n).select(F.lit(1).alias("document_id"), F.col("id").alias("j"), (F.col("id") * 7 + 3).alias("g_start"), (F.col("id") * 7 + 9).alias("g_end"))
    began = time.perf_counter()
    assert spans.overlap_join(chunks, gold).count() == 2 * n - 1
    row = spans.containment(gold, chunks, ["document_id"]).agg(F.count_if("contained"), F.sum("touched")).first()
    assert tuple(row) == (n, 2 * n - 1)
    points = gold.select("document_id", "j", F.col("g_start").alias("ref_start"))
    assert spans.point_in_span(points, chunks).count() == n
    assert time.perf_counter() - began < 90


def tree(spark, rows):
    return spark.createDataFrame(rows, "document_id string, identifier string, parent string, g_end int")


def test_subtree_ends_of_depth_six(spark):
    """Ends along a chain of six, the furthest at its foot; documents with the same identifiers; an unknown parent."""
    chain = [("d", "a", None, 10), ("d", "b", "a", 20), ("d", "c", "b", 30), ("d", "e", "c", 40), ("d", "f", "e", 15), ("d", "g", "f", 90)]
    other = [("e", "a", None, 5), ("e", "g", "nowhere", 70), ("e", "b", "a", 8), ("e", "c", "a", 6)]
    got = {(r.document_id, r.identifier): r.subtree_end for r in spans.subtree_ends(tree(spark, chain + other)).collect()}
    assert [got["d", c] for c in "abcefg"] == [90] * 6
    assert got["e", "a"] == 8 and got["e", "g"] == 70 and got["e", "b"] == 8 and got["e", "c"] == 6


def test_subtree_ends_of_random_trees(spark):
    draw = random.Random(8)
    rows, want = [], {}
    for d in range(30):
        parents = [None if k == 0 or draw.random() < 0.1 else draw.randrange(max(0, k - 4), k) for k in range(draw.randrange(1, 60))]
        ends = [draw.randrange(1000) for _ in parents]
        best = ends[:]
        for k in reversed(range(len(parents))):
            if parents[k] is not None:
                best[parents[k]] = max(best[parents[k]], best[k])
        rows += [(f"d{d}", f"c{k}", None if p is None else f"c{p}", e) for k, (p, e) in enumerate(zip(parents, ends))]
        want |= {(f"d{d}", f"c{k}"): e for k, e in enumerate(best)}
    draw.shuffle(rows)
    assert {(r.document_id, r.identifier): r.subtree_end for r in spans.subtree_ends(tree(spark, rows)).collect()} == want


def test_repeated_identifiers_are_one_clause(spark):
    got = spans.subtree_ends(tree(spark, [("d", "a", None, 1), ("d", "b", None, 2), ("d", "x", "a", 9), ("d", "x", "b", 3)])).collect()
    assert {(r.identifier, r.subtree_end) for r in got} == {("a", 9), ("b", 9), ("x", 9)} and len(got) == 4


@pytest.mark.parametrize("rows", [[("d", "a", "a", 1)], [("d", "a", "b", 1), ("d", "b", "c", 2), ("d", "c", "a", 3), ("d", "x", None, 4)]])
def test_cycles_are_errors(spark, rows):
    with pytest.raises(PythonException, match="CycleError"):
        spans.subtree_ends(tree(spark, rows)).collect()


def test_a_long_chain():
    n = 50_000
    best, open_ = sweep.highest_below(np.arange(n), np.arange(-1, n - 1), np.arange(n))
    assert (best == n - 1).all() and not len(open_)
