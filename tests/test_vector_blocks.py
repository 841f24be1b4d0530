"""Vector scores within tasks: against every pair by hand, with ties, other dimensions, missing components and NaN."""

import math
import random

import pytest

from spanlab.operators import vector as V


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    vectors = [(i, i % 4, [draw.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors += [(i + 300, 9, vectors[i % 5][2]) for i in range(200)]  # copies, which tie
    vectors += [(600, 1, [1.0, 2.0]), (601, 1, None), (602, None, [0.0] * 8), (603, 7, [math.nan] + [1.0] * 7), (604, 5, [None] + [1.0] * 7)]
    return [(i, v[2]) for i, v in enumerate(vectors[:40])] + [(50, [3.0, 1.0])], vectors


def by_hand(q, v):
    out = 0.0
    for x, y in zip(q, v):
        if x is None or y is None:
            return None
        out += x * y
    return out


def first(score):  # NaN, numbers from the greatest, null
    return (2, 0.0) if score is None else (0, 0.0) if math.isnan(score) else (1, -score)


def frames(spark, rows):
    return spark.createDataFrame(rows[0], "query_id bigint, q array<double>"), spark.createDataFrame(rows[1], "vec_id bigint, label int, vec array<double>").repartition(3)


@pytest.mark.parametrize("k, block, tile", [(4, 20_000, 1 << 22), (4, 11, 60), (400, 20_000, 1 << 22)])
def test_first_of_each_query(spark, rows, monkeypatch, k, block, tile):
    monkeypatch.setattr(V, "BROADCAST_QUERIES", block)
    monkeypatch.setattr(V, "TILE", tile)
    q, v = frames(spark, rows)
    got = {}
    for r in V.top_k(q, v, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, str(r.score)))
    for key, vector in rows[0]:
        met = [(i, by_hand(vector, x)) for i, _, x in rows[1] if x is not None and len(x) == len(vector)]
        met.sort(key=lambda x: (*first(x[1]), x[0]))
        assert got[key] == [(i, str(s)) for i, s in met[:k]]


def test_best_of_each_label(spark, rows):
    q, v = frames(spark, rows)
    got = {(r.query_id, r.label): str(r.score) for r in V.scored(q, v.drop("vec_id"), "label").collect()}
    want = {}
    for key, vector in rows[0]:
        for _, label, x in rows[1]:
            if x is not None and len(x) == len(vector):
                want.setdefault((key, label), []).append(by_hand(vector, x))
    assert got == {at: str(min(scores, key=first)) for at, scores in want.items()}
    assert V.scored(q, v).count() == sum(x is not None and len(x) == len(vector) for _, vector in rows[0] for *_, x in rows[1])


def test_scores_stay_in_their_tasks(spark, rows):
    plan = V.top_k(*frames(spark, rows), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
