"""Clauses by numbering: starts of paragraphs, headings and zones in the four styles, by hand."""

import pytest

from spanlab.operators import extract


def read(text, style):
    return [(c["identifier"], c["level"], c["parent"], c["heading"]) for c in extract.clauses(text, style)]


def test_headings_are_paragraphs():
    """Up to the next blank line (of white space too), on one line, without what frames it."""
    long = "word " * 40
    text = f"1. Scope\nof this\n deed:\n\n1.1 Terms – \n\t\n1.2 {long}\n\n2. – Fees —"
    assert read(text, "uk_decimal") == [("1", 1, None, "Scope of this deed"), ("1.1", 2, "1", "Terms"), ("2", 1, None, "Fees")]  # 1.2 has no empty line before it
    text = f"1. Scope\n\n1.2 {long}"
    assert read(text, "uk_decimal")[1][3] == long[:120]


def test_sentences_as_headings():
    text = "Section 1.01 Payment\nterms. The buyer pays.\n\nSection 1.02 Rule 4.5 applies here\n\nSection 1.03 . None"
    assert [c[3] for c in read(text, "us_article_section")] == ["Payment terms", "Rule 4.5 applies here", ". None"]
    assert [c[3] for c in read("Section 1. Payment. Terms.\n\nSection 1.1 Fees. All.", "us_section_decimal")] == ["Payment. Terms.", "Fees"]


@pytest.mark.parametrize(
    ("style", "first", "second", "names"),
    [
        ("uk_decimal", "1. One", "2. Two", ["1", "2"]),
        ("eu_regulation", "CHAPTER I\nOne", "CHAPTER II\nTwo", ["chapter_1", "chapter_2"]),
        ("us_article_section", "ARTICLE I\nOne", "ARTICLE II\nTwo", ["article_1", "article_2"]),
        ("us_section_decimal", "Section 1. One", "Section 2. Two", ["section_1", "section_2"]),
    ],
)
def test_a_line_of_spaces_starts_no_paragraph(style, first, second, names):
    found = lambda gap: [c[0] for c in read(first + gap + second, style)]
    assert found("\n\n") == found("\n \n\n") == names
    assert found("\n \n") == found("\n\t\n") == found("\n") == names[:1]
    assert [c[0] for c in read("\n" + first, style)] == []  # a lone line feed isn't an empty line between paragraphs
    assert [c[0] for c in read("\n\n" + first, style)] == names[:1]


def test_eu_zones():
    text = (
        "(1) A recital,\nwrapped.\n\nCHAPTER I\nGeneral\n\n(2) no recital\n\nArticle 1\nScope\n\n1. First\nitem\n\nCHAPTER II\nMore\n\n2. Still of one\n\n"
        "see\nArticle 5\n\n3. Of none\n\nArticle 2\nEnd\n\n1. Up to\nArticle 3\n\n"
    )
    assert read(text, "eu_regulation") == [
        ("recital_1", 1, None, "A recital, wrapped."), ("chapter_1", 1, None, "General"), ("article_1", 2, "chapter_1", "Scope"),
        ("article_1_1", 3, "article_1", "First item"), ("chapter_2", 1, None, "More"), ("article_1_2", 3, "article_1", "Still of one"),
        ("article_2", 2, "chapter_2", "End"), ("article_2_1", 3, "article_2", "Up to"),
    ]


def test_uk_zones():
    text = (
        "1.1 Early\n\n1. One\n\n(a) not of a sub-clause\n\n1.2 List:\n\n(a) apples\n(b) pears\n(d) no\n(c) no\n\n(a) again\n  (b) spaced\n\n2. Two\n\n(c) no\n\n"
        "on\nSCHEDULE 1 Not at a paragraph\n\n1. Skipped\n\nSCHEDULE 2 – Fees\n\n1.1 Before any\n\n1. Rates\n\n1.2 Late\n\n(a) no list\n"
    )
    assert read(text, "uk_decimal") == [
        ("1.1", 2, None, "Early"), ("1", 1, None, "One"), ("1.2", 2, "1", "List"), ("1.2(a)", 3, "1.2", "apples (b) pears (d) no (c) no"),
        ("1.2(b)", 3, "1.2", "pears (d) no (c) no"), ("1.2(a)", 3, "1.2", "again (b) spaced"), ("1.2(b)", 3, "1.2", "spaced"), ("2", 1, None, "Two"),
        ("schedule_2", 1, None, "Fees"), ("schedule_2.1.1", 3, None, "Before any"), ("schedule_2.1", 2, "schedule_2", "Rates"),
        ("schedule_2.1.2", 3, "schedule_2.1", "Late"),
    ]
    items = [c for c in extract.clauses(text, "uk_decimal") if c["identifier"] == "1.2(b)"]
    assert text[items[1]["g_start"] : items[1]["marker_end"]] == "(b) "
    schedule = extract.clauses("SCHEDULE 7 Rates of pay\n\n", "uk_decimal")[0]
    assert schedule["marker_end"] == len("SCHEDULE 7 Rates of pay")


def test_us_zones():
    text = (
        "ARTICLE IV\nRisk\n\nSection 4.01 Loss. Of goods\nSection 4.02(b) Some. More\n\n(a) of none\n\nSection 4.03 List. As\n\n(a) one\n\nARTICLE V\nRest\n\n"
        "(b) two\n\nSection 5.01 Last.\n\n(b) no\n\nEXHIBIT A\n\nSection 9.99 Not this. No.\n"
    )
    assert read(text, "us_article_section") == [
        ("article_4", 1, None, "Risk"), ("section_4.01", 2, "article_4", "Loss"), ("section_4.02(b)", 3, "section_4.02", "Some"),
        ("section_4.03", 2, "article_4", "List"), ("section_4.03(a)", 3, "section_4.03", "one"), ("article_5", 1, None, "Rest"),
        ("section_4.03(b)", 3, "section_4.03", "two"), ("section_5.01", 2, "article_5", "Last"),
    ]
    text = "Section 1. Use\n\nSection 1.1 Rules. All of\n\n(a) one\n(b) two\n\nSection 2. Fees\n\n(c) no\n\nsee\nSection 2.1 No. Paragraph\n"
    assert read(text, "us_section_decimal") == [
        ("section_1", 1, None, "Use"), ("section_1.1", 2, "section_1", "Rules"), ("section_1.1(a)", 3, "section_1.1", "one (b) two"),
        ("section_1.1(b)", 3, "section_1.1", "two"), ("section_2", 1, None, "Fees"),
    ]


def test_texts_without_clauses():
    for style in extract.MARKS:
        assert read("", style) == [] and read("plain words\n\nand more", style) == []
