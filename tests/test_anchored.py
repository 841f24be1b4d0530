"""Items are sought verbatim where the documents are: against `str.find`, in blocks, and without a shuffle or a join."""

import random

import pytest

from spanlab.operators import lexical


def frames(spark, items, docs):
    return spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "document_id bigint, text string")


def by_hand(items, docs):
    return sorted((i, d, t.find(x), t.find(x) + len(x)) for i, x in items if x for d, t in docs if t is not None and x in t)


def found(spark, items, docs):
    return sorted(map(tuple, lexical.anchored(*frames(spark, items, docs)).select("item_id", "document_id", "g_start", "g_end").collect()))


def test_within_words_and_without_words(spark):
    """An item may begin or end within a word of the document, or have no word at all."""
    items = [(1, "art of war"), (2, "?! -- ?!"), (3, "Straße"), (4, "STRASSE"), (5, ""), (6, None), (7, "𝄞x")]
    docs = [(1, "a cart of wares, an art of war"), (2, "what?! -- ?!"), (3, "Hauptstraßenbahn Straßen"), (4, None), (5, ""), (6, "𝄞𝄞𝄞xy")]
    assert found(spark, items, docs) == by_hand(items, docs) == [(1, 1, 3, 13), (2, 2, 4, 12), (3, 3, 17, 23), (7, 6, 2, 4)]


@pytest.mark.parametrize("block", [20_000, 7])
def test_many_items(spark, monkeypatch, block):
    """Passages that overlap, hold each other, stand twice, share their start, or share their text."""
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    draw = random.Random(3)
    docs = [(d, "".join(draw.choice("ab ") for _ in range(draw.choice((0, 40, 400))))) for d in range(60)]
    docs += [(d + 60, t) for d, t in docs[:20]]
    cut = [(t[a : a + n]) for t in (draw.choice(docs)[1] for _ in range(60)) for a, n in [(draw.randrange(len(t) + 1), draw.choice((1, 5, 31, 32, 33, 90)))]]
    cut += [c[:-1] + "c" for c in cut if len(c) > 40] + cut[:5]
    items = list(enumerate(cut))
    assert found(spark, items, docs) == by_hand(items, docs)


def test_no_text_is_shuffled(spark):
    """Many items that share their longest word: a row for each with each document that holds it would be their product."""
    rows = lexical.anchored(*frames(spark, [(1, "some passage")], [(1, "here is some passage.")]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_no_items(spark):
    assert found(spark, [], [(1, "a")]) == []
