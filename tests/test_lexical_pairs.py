"""Lexical pairs are scored within tasks: against every pair by hand, in blocks of queries, with ties and repeated keys."""

import math
import random
from collections import Counter

import pytest

from spanlab.operators import lexical

KEY = ["document_id", "char_start"]


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choice(words[: draw.choice((3, 60))]) for _ in range(n))
    queries = [(i, text(12)) for i in range(70)] + [(90, "Nothing shared"), (91, ""), (92, None)]
    candidates = [(d, s, text(30)) for d in range(60) for s in (0, 30)]
    candidates += [(d + 60, s, t) for d, s, t in candidates[:40]]  # copies, which tie
    candidates += [(3, 0, "w1 w1 unknown"), (200, 0, None), (201, 0, "...")]  # a key that stands twice counts as one candidate
    return queries, candidates


def by_hand(queries, candidates):
    own = {}
    for d, s, text in candidates:
        own.setdefault((d, s), Counter()).update((text or "").split())
    length = lambda c: math.sqrt(sum(n * n for n in c.values()))
    out = {}
    for q, text in queries:
        asked = Counter((text or "").lower().split())
        for key, held in own.items():
            dot = sum(n * held[w] for w, n in asked.items())
            if dot:
                out[q, *key] = dot / (length(asked) * length(held))
    return out


def frames(spark, sides):
    queries, candidates = sides
    return spark.createDataFrame(queries, "query_id bigint, text string"), spark.createDataFrame(candidates, "document_id bigint, char_start bigint, text string")


@pytest.mark.parametrize("block, tile", [(20_000, 1 << 22), (9, 100)])
def test_pairs_ranks_and_counts(spark, sides, monkeypatch, block, tile):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    monkeypatch.setattr(lexical, "TILE", tile)
    want = by_hand(*sides)
    q, c = frames(spark, sides)
    assert {(r.query_id, r.document_id, r.char_start): r.score for r in lexical.scored(q, c, KEY).collect()} == want
    above = {at: s for at, s in want.items() if s > 0.35}
    assert {(r.query_id, r.document_id, r.char_start): r.score for r in lexical.scored(q, c, KEY, 0.35).collect()} == above
    assert {r.query_id: r.candidates for r in lexical.sharing(q, c, KEY).collect()} == Counter(at[0] for at in want)
    best = {}
    for at, score in sorted(want.items(), key=lambda x: (x[0][0], -x[1], x[0][1:])):
        best.setdefault(at[0], []).append((*at[1:], score))
    got = {}
    for r in lexical.ranked(q, c, 7, KEY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.document_id, r.char_start, r.score))
    assert got == {q: rows[:7] for q, rows in best.items()}


def test_pairs_stay_in_their_tasks(spark, sides):
    """What is shuffled for a ranking doesn't grow with the pairs: candidates once, and the first few of each task."""
    q, c = frames(spark, sides)
    plan = lexical.ranked(q, c, 3, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_budgets_share_one_ranking(spark, monkeypatch):
    from spanlab.plans import span_queries as P

    calls = []
    for name in ("ranking", "evidence"):
        plain = getattr(P, name)
        monkeypatch.setattr(P, name, lambda *a, _plain=plain, _name=name, **k: calls.append(_name) or _plain(*a, **k))
    P.agg5(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["evidence", "ranking"]
