"""Localisation by anchors: the same as plain searches, and linear in long documents."""

import random
import time

import pytest

from spanlab.operators import chunkers, locate


def plain(text, chunks):
    """With searches of the whole text for every end of every chunk."""
    out, cursor = [], 0
    for chunk in chunks:
        at = locate._found(text, chunk, cursor) if chunk.strip() else -1
        if at >= 0:
            out.append((at, at + len(chunk), len(chunk), True))
        elif chunk.strip() and (near := locate.joined(locate._affix(text, chunk, False, cursor), locate._affix(text, chunk, True, cursor), len(chunk))):
            out.append((*near, False))
        else:
            out.append((None, None, 0, False))
            cursor = 0
            continue
        cursor = max(cursor, out[-1][1])
    return out


@pytest.mark.parametrize(("anchor", "shortest"), [(32, 8), (3, 1), (1, 1), (5, 3)])
def test_same_as_plain_searches(monkeypatch, anchor, shortest):
    monkeypatch.setattr(locate, "ANCHOR", anchor)
    monkeypatch.setattr(locate, "SHORTEST", shortest)
    draw = random.Random(anchor)
    for _ in range(400):
        text = "".join(draw.choices(draw.choice(["ab", "ab c.", "abcdefgh é𝄞"]), k=draw.randrange(120)))
        chunks = []
        for _ in range(8):
            a = draw.randrange(len(text) + 1)
            piece = list(text[a : a + draw.randrange(60)])
            for _ in range(draw.randrange(3)):
                piece.insert(draw.randrange(len(piece) + 1), draw.choice("xab "))
            chunks.append("".join(piece))
        assert locate.located_in(text, chunks) == plain(text, chunks)
        assert locate.located_in(text, chunks, fuzzy=False) == [r if r[3] else (None, None, 0, False) for r in locate.located_in(text, chunks, fuzzy=False)]


def test_ten_megabytes_with_altered_chunks():
    """20,000 chunks of a text of ten million characters, each altered within; and again where sentences repeat."""
    draw = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    for repeated in (False, True):
        sentences = [" ".join(draw.choices(words, k=90)) + ". " for _ in range(200 if repeated else 20_000)]
        parts = [draw.choice(sentences) for _ in range(20_000)] if repeated else sentences
        text = "".join(parts)
        assert len(text) > 9_000_000
        chunks = [p[: len(p) * 2 // 3] + "#" + p[len(p) * 2 // 3 :] for p in parts]
        began = time.perf_counter()
        found = locate.located_in(text, chunks)
        assert time.perf_counter() - began < 60
        at = 0
        for part, (start, end, covered, exact) in zip(parts, found):
            assert not exact and start is not None and covered >= len(part) * 2 // 3
            if not repeated:
                assert (start, end) == (at, at + len(part) * 2 // 3)  # the rest is less than half
            at += len(part)


def test_sentence_texts_against_a_plain_fold(spark):
    text = "One. two Three! Four?\n\nfive.  Six" + " long words here" * 9 + ". Seven.\n \nEight"
    rows = chunkers.sentence_split(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "document_id int, text string"), 20).collect()
    assert [(r.document_id, r.chunk_index, r.text) for r in rows] == [(1, k, t) for k, t in enumerate(chunkers.sentence_texts(text, 20))]
    assert " ".join(r.text for r in rows).split() == text.split() and all(len(r.text) >= 20 for r in rows[:-1]) and rows[0].char_start is None
