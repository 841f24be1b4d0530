"""Superseded metrics: a document's are made in its row, and they are those that comparing all pairs gives."""

import random
import re

import pytest

from spanlab.operators import chunkers, extract, legacy
from spanlab.plans import catalog
from tests.test_oracles import SF

PIECES = [
    "1. Scope of it\n\n", "2. Payment, see\n\n", "1.1 The fee is due\n\n", "1.2.3. deep\n", "SCHEDULE 1 Things\n\n", "\n\n", "\r\n", "\r", "\x85", "\u2028", "\x1c", "\xa0", "\u3000", "\n",
    "under Section 1.2 ", "Subject  to\nCLAUSE 3.", "pursuant to Article (4)", "as set forth in clause 1.1) ", "referred to in Clause 1", "UNDER clause 1.2.3", "  Section 1.2: ", "## clause\t3. next", "Clause 1.2 - x", "(4)", "Article (4)\u2014", "12 ", "1.1)\r",
    '"Term" means a thing. ', "'Fee Note' shall  mean it. ", '"TERM"', '"A   "', "refers to ", "the term ", "fee note ", "x" * 85, "\u0130stanbul \u1e9e \u03a3\u039f\u03a6\u039f\u03a3 ", "\U0001d400 ", "alpha beta gamma delta. ", "One two three four five. ", " " * 25,
]
CUTS = {"fixed_size": lambda t: [t[a:b] for a, b in chunkers.fixed_spans(t, 60)], "sentence_split": lambda t: chunkers.sentence_texts(t, 30)}


def by_pairs(text, chunks):
    """The definitions, each chunk against each clause, term and reference."""
    words = lambda t: {w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w}
    found = extract.clauses(text, "uk_decimal")
    clauses = [(c["identifier"], text[c["g_start"] : e]) for c, e in zip(found, [*(c["g_start"] for c in found[1:]), len(text)])]
    best = {}
    for name, c in clauses:
        if len(c.strip(" ")) >= 20:
            best[name] = max([best.get(name, 0.0), *(1.0 if c in t else len(words(c) & words(t)) / max(1, len(words(c))) for t in chunks)])
    terms = {t for q in legacy.QUOTED for t in re.findall(q, text, re.A) if len(t.strip(" ")) >= 2}
    defined = [any(re.search(rf"(?s){re.escape(t.strip(' ').lower())}[\"']?[ \t\n\x0b\f\r]*.{{0,80}}?(?a:{legacy.DEFINING})", c.lower()) is not None for c in chunks) for t in terms]
    refs = [m[0] for lead in legacy.LEADS for m in re.finditer(f"(?ia){lead}{legacy.TARGET}", text)]
    resolved = []
    for r in refs:
        kind, number = re.search(r"(\w+)\s+([\d.()]+)$", r.lower()).groups()
        # A line feed for each of Spark's line ends.
        lines = lambda t: re.sub("\r\n|[\r\x85\u2028\u2029]", "\n", t)
        heading = rf"(?aim)^[ \t]*(?:#{{1,6}}[ \t]*)?(?:{kind}[ \t]+)?{re.escape(number)}(?=$|[ \t:\u2014-]|\.(?!\d)|\)(?!\d))"
        resolved.append(any(r.lower() in c.lower() and re.search(heading, lines("\n".join(chunks[max(0, i - 1) : i + 2]))) is not None for i, c in enumerate(chunks)))
    deep = lambda pattern, t: [m[1].count(".") + 1 for m in re.finditer(pattern, t, re.A)]
    depth = max([1, *deep(r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))(\d+(?:\.\d+)*)\.", text)])
    own = max([0, *(d for c in chunks for d in deep(r"(\d+(?:\.\d+)*)\.", c))])
    sizes = [len(c) for c in chunks]
    mean = sum(sizes) / len(sizes)
    return (
        (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5 / mean,
        sum(b < 0.8 for b in best.values()) / len(best) if best else 0.0,
        sum(defined) / len(defined) if defined else 1.0,
        sum(resolved) / len(resolved) if resolved else 1.0,
        1.0 if depth <= 1 else min(own / depth, 1.0),
    )


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    return [None, "", " \n", "1. " + "\n" * 30, *("".join(draw.choices(PIECES, k=draw.choice([3, 20, 80]))) for _ in range(150))]


def got(rows):
    return {(r.document_id, r.strategy): tuple(r[m] for m in legacy.METRICS) for r in rows.collect()}


def test_in_place_and_by_rows_as_by_pairs(spark, texts):
    docs = spark.createDataFrame([(k, t, "uk_decimal") for k, t in enumerate(texts)], "document_id long, text string, numbering_style string")
    want = {(k, name): by_pairs(t, cut(t)) for k, t in enumerate(texts) for name, cut in CUTS.items() if t and cut(t)}
    in_place = got(legacy.legacy_row_in_place(docs, CUTS))
    chunks = chunkers.chunk(docs, [*CUTS], {"fixed_size": {"size": 60}, "sentence_split": {"min_chars": 30}})
    by_rows = got(legacy.legacy_row(chunks, docs, extract.clause_table(extract.extracted(docs))))
    assert in_place == by_rows
    assert in_place.keys() == want.keys()
    for k, values in want.items():
        assert in_place[k] == pytest.approx(values, abs=1e-9), texts[k[0]]
    assert all(len({v[k] for v in want.values()}) > 2 for k in range(4))


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_fragmentation_with_many_chunks(monkeypatch, few):
    monkeypatch.setattr(legacy, "FEW", few)
    draw = random.Random(4)
    for _ in range(300):
        clauses = [(str(draw.randrange(6)), " ".join(draw.choices("abcdefghijkl", k=draw.choice([3, 11, 14])))) for _ in range(8)]
        chunks = [" ".join(draw.choices("abcdefghijkl", k=draw.choice([2, 9, 12]))) for _ in range(7)]
        best = {}
        for name, c in clauses:
            if len(c) >= 20:
                best[name] = max([best.get(name, 0.0), *(1.0 if c in t else len({*c.split()} & {*t.split()}) / len({*c.split()}) for t in chunks)])
        assert legacy.fragmentation(chunks, legacy.Truth(clauses, [], [], 1)) == (sum(b < 0.8 for b in best.values()) / len(best) if best else 0.0)


def test_texts_of_as_chunk(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts)], "document_id long, text string")
    names = ["fixed_size", "token_window", "sentence_split", "sentence_window", "rcts_512", "rcts_1024"]
    rows = chunkers.chunk(docs, names).collect()
    want = {(r.strategy, r.document_id, r.chunk_index): r.text for r in rows}
    assert {(n, k, i): c for n in names for k, t in enumerate(texts) for i, c in enumerate(chunkers.texts_of(n)(t or ""))} == want
    with pytest.raises(ValueError):
        chunkers.texts_of("clause_aware")


def test_no_row_is_shuffled_by_its_document(spark):
    """Small inputs are spread over the cores, by no key."""
    plan = catalog.queries()["lg_legacy_row"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Aggregate|Window|hashpartitioning|rangepartitioning", plan)
