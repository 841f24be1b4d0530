"""Clause-aware chunks in the four numbering styles, by hand; terms and references; contextual chunks; metrics that read them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanlab.operators import chunkers, clause_aware as A, extract, structural as S
from spanlab.operators.terms import Phrases, folded, is_whole


def cut(spark, text, jurisdiction, **parameters):
    docs = spark.createDataFrame([("d", text, jurisdiction)], "document_id string, text string, jurisdiction string")
    rows = A.clause_aware(docs, **({"min_chars": 1, "max_chars": 1200} | parameters)).orderBy("chunk_index").collect()
    assert all(text[r.char_start : r.char_end] == r.text for r in rows) and [r.chunk_index for r in rows] == [*range(len(rows))]
    return rows


UK = (
    'This deed.\n\n1. Terms\n\n1.1 In this deed:\n\n(a) "Fees" means charges; and\n(b) "Goods" means things.\n\n2. Payment\n\n'
    "2.1 The buyer shall pay the fees by invoice under clause 1.1 and paragraph 1 of Schedule 1.\n\nSCHEDULE 1 Rates\n\n1. GOODS cost ten.\n"
)


def test_uk(spark):
    rows = cut(spark, UK, "uk")
    assert [r.section_hierarchy for r in rows] == [
        None, "1 Terms", "1 Terms > 1.1 In this deed", '1 Terms > 1.1 In this deed > (a) "Fees" means charges; and (b) "Goods" means things.',
        '1 Terms > 1.1 In this deed > (b) "Goods" means things.', "2 Payment",
        "2 Payment > 2.1 The buyer shall pay the fees by invoice under clause 1.1 and", "Schedule 1 Rates", "Schedule 1 Rates > Schedule 1.1 GOODS cost ten.",
    ]
    assert [r.defined_terms for r in rows] == [[], [], [], ["Fees"], ["Goods"], [], ["Fees"], [], ["Goods"]]
    assert [(x.raw_text, x.target) for x in rows[6].cross_references] == [("1.1", "1.1"), ("paragraph 1 of Schedule 1", "schedule_1.1"), ("Schedule 1", "schedule_1")]
    assert all(r.cross_references == [] for r in rows[:6])
    assert [r.clause_type for r in rows][5:7] == ["payment", "payment"] and rows[0].clause_type is None and rows[0].confidence is None
    assert rows[3].clause_type == "definitions" and 0 < rows[6].confidence < 1


def test_eu(spark):
    text = (
        "(1) Whereas data matter.\n\nCHAPTER II\nRules\n\nArticle 5\nLawfulness of processing\n\n1. A controller shall act by Article 6.\n\n"
        "2. Personal data shall be kept.\n\nArticle 6\nNotices\n\nIn writing.\n"
    )
    rows = cut(spark, text, "eu")
    chapter = "Chapter 2 Rules"
    assert [r.section_hierarchy for r in rows] == [
        "Recital 1 Whereas data matter.", chapter, f"{chapter} > Article 5 Lawfulness of processing",
        f"{chapter} > Article 5 Lawfulness of processing > paragraph 1 A controller shall act by Article 6.",
        f"{chapter} > Article 5 Lawfulness of processing > paragraph 2 Personal data shall be kept.", f"{chapter} > Article 6 Notices",
    ]
    assert [(x.raw_text, x.target) for x in rows[3].cross_references] == [("Article 6", "article_6")] and rows[5].cross_references == []
    assert rows[4].clause_type == "data_protection" and rows[5].clause_type == "notices"


def test_us_articles_and_sections(spark):
    text = "ARTICLE VIII\nIndemnity\n\nSection 8.01 Scope. The seller shall indemnify. See Sections 8.01 and 9.02.\n\n(a) in full\n(b) at once\n\nEXHIBIT A\n\nSection 9.99 none.\n"
    rows = cut(spark, text, "us")
    section = "Article 8 Indemnity > Section 8.01 Scope"
    assert [r.section_hierarchy for r in rows] == ["Article 8 Indemnity", section, f"{section} > (a) in full (b) at once", f"{section} > (b) at once"]
    assert [x.target for x in rows[1].cross_references] == ["section_8.01", "section_9.02"] and rows[1].clause_type == "indemnity"
    assert rows[3].text.endswith("Section 9.99 none.")  # after an exhibit there are no clauses


def test_us_decimal_sections(spark):
    text = "Section 1. Use\n\nSection 1.1 Rules. All must agree.\n\n(a) one\n\nSection 2. Governing Law\n\nThe courts of Ohio.\n"
    rows = cut(spark, text, "us")
    assert [r.section_hierarchy for r in rows] == [
        "Section 1 Use", "Section 1 Use > Section 1.1 Rules", "Section 1 Use > Section 1.1 Rules > (a) one", "Section 2 Governing Law",
    ]
    assert rows[3].clause_type == "governing_law"


def test_short_units_grow_below_and_beside(spark):
    rows = cut(spark, UK, "uk", min_chars=60)
    assert [r.section_hierarchy for r in rows][:4] == [None, "1 Terms", "2 Payment", "Schedule 1 Rates"]
    assert rows[1].text.startswith("1. Terms") and rows[1].text.endswith("things.") and rows[1].defined_terms == ["Fees", "Goods"]
    whole = cut(spark, UK, "uk", min_chars=10_000)
    assert [r.text.split(" ")[0] for r in whole] == ["This", "1.", "2.", "SCHEDULE"]  # top-level clauses stay apart
    assert all(r.char_end - r.char_start <= 40 for r in cut(spark, UK, "uk", max_chars=40))


def test_jurisdictions(spark):
    docs = spark.createDataFrame([("us_x", "Section 1. Use\n\nA.\n"), ("eu_y", "Article 1\nScope\n\nB.\n"), ("z", "1. One\n\nC.\n"), ("nothing", None)], "document_id string, text string")
    got = {r.document_id: r.section_hierarchy for r in A.clause_aware(docs).collect()}
    assert got == {"us_x": "Section 1 Use", "eu_y": "Article 1 Scope", "z": "1 One"}
    pinned = {r.document_id: r.section_hierarchy for r in A.clause_aware(docs, jurisdiction="uk").collect()}
    assert pinned == {"us_x": None, "eu_y": None, "z": "1 One"}
    with pytest.raises(ValueError):
        A.clause_aware(docs, jurisdiction="fr")


def test_contextual_in_the_registry(spark):
    docs = spark.createDataFrame([("d", UK)], "document_id string, text string")
    rows = {r.original_text: r for r in chunkers.chunk(docs, ["contextual", "fixed_size"], {"contextual": {"min_chars": 1}}).where("strategy = 'contextual'").collect()}
    last = rows["1. GOODS cost ten."]
    assert last.text == "[Section: Schedule 1 Rates > Schedule 1.1 GOODS cost ten. | Terms: Goods]\n1. GOODS cost ten."
    assert rows["This deed."].text == "This deed."
    sent = next(r for r in rows.values() if r.original_text.startswith("2.1"))
    assert "| Type: payment | Terms: Fees | Refs: 1.1, paragraph 1 of Schedule 1, Schedule 1]\n" in sent.text


def test_structural_metrics_read_the_chunks(spark):
    """Headings, definitions and references of clause-aware chunks against the document's own clauses."""
    docs = spark.createDataFrame([("d", UK, "uk_decimal")], "document_id string, text string, numbering_style string")
    chunks = A.clause_aware(docs, 1, 1200).withColumn("strategy", F.lit("clause_aware"))
    found = extract.extracted(docs)
    row = S.headings(chunks, extract.clause_table(found)).first()
    assert (row.heading_precision, row.heading_recall) == (1.0, 1.0)
    row = S.cross_references(chunks, extract.reference_table(found)).first()
    assert (row.xref_recall, row.xref_precision, row.n_gold_cross_refs) == (1.0, 1.0, 3)
    row = S.definition_attachment(chunks, docs, extract.term_table(docs)).first()
    assert (row.definition_attachment, row.n_definition_uses) == (0.0, 2)


def test_definitions_at_hand(spark):
    text = '"Fee" means a sum. Pay the FEE. feed. "Fee" means tax.'
    first, second, end = 0, text.index('"Fee" means tax'), len(text)
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    terms = spark.createDataFrame([("d", "Fee", first, 18), ("d", "Fee", second, end), ("d", "Nowhere", 0, 1)], "document_id string, term string, definition_start int, definition_end int")
    at = text.index("FEE")
    chunks = [("whole", 0, 0, end, {}), ("cut", 0, at, at + 3, {"Fee": "  "}), ("cut", 1, at + 3, end, {"Fee": "a sum"}), ("edge", 0, text.index("feed"), text.index("feed") + 3, None), ("lost", 0, None, None, None)]
    rows = spark.createDataFrame([(s, "d", *c) for s, *c in chunks], "strategy string, document_id string, chunk_index int, char_start int, char_end int, definitions map<string,string>")
    got = {r.strategy: (r.n_definition_uses, r.definition_attachment) for r in S.definition_attachment(rows, docs, terms).collect()}
    # Uses: one for each definition that has a find outside of it. A chunk's end is a word's end.
    assert got == {"whole": (2, 1.0), "cut": (3, 1 / 3), "edge": (2, 0.0), "lost": (0, 1.0)}


def test_phrases_against_patterns():
    draw = random.Random(4)
    for _ in range(300):
        phrases = ["".join(draw.choices("aAb -İ", k=draw.randrange(5))) for _ in range(6)]
        text = "".join(draw.choices("aAbB -_İß", k=60))
        want = {(m, p) for p in phrases if p for m in range(len(text)) if folded(text)[m : m + len(p)] == folded(p) and is_whole(text, m, m + len(p))}
        found = Phrases(phrases)
        assert {(at, found.phrases[n]) for at, n in found.places(text)} == want
    plain = {m.start() for m in re.finditer(r"\bterm\b", "Term, terms; TERM", re.I)}
    assert {at for at, _ in Phrases(["term"]).places("Term, terms; TERM")} == plain
