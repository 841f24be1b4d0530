"""Structure of documents: clauses by numbering, defined terms, cross-references.

Clauses depend on the ones before them, so a document's lines are read in order against the rules of its numbering style,
in Arrow batches; ends and parents follow relationally (`spans.finalized`). Terms and references are expressions over the
text: what a pattern finds and what lies between gives the offsets, windows and joins do the rest.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions.text import let, piece_starts, roman_to_int

# The value of each letter of a Roman numeral.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int:
    """A letter counts against the next one if that is larger."""
    values = [ROMAN[c] for c in text.lower()]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


# What marks a clause, in each style, at the start of a line. Only the kinds named `anywhere` count where no
# empty line goes before. Letters are items of a list.
LETTER = r"[ \t]*\(([a-z])\)[ \t]+"
MARKS: dict[str, dict[str, str]] = {
    "eu_regulation": {
        "chapter": r"CHAPTER[ \t]+([IVXLCDM]+)[ \t]*$",
        "article": r"Article[ \t]+(\d+)[ \t]*$",
        "recital": r"\((\d+)\)[ \t]+",
        "item": r"(\d+)\.[ \t]+",
    },
    "uk_decimal": {
        "schedule": r"SCHEDULE[ \t]+(\d+)\b[ \t]*(.*)$",
        "sub": r"(\d+\.\d+)[ \t]+(?=\S)",
        "top": r"(\d+)\.[ \t]+(?=\S)",
        "letter": LETTER,
    },
    "us_article_section": {
        "exhibit": r"EXHIBIT[ \t]+[A-Z0-9]+\b",
        "article": r"ARTICLE[ \t]+([IVXLCDM]+)[ \t]*$",
        "lettered": r"Section[ \t]+(\d+\.\d+)\(([a-z])\)[ \t]+(?=\S)",
        "sub": r"Section[ \t]+(\d+\.\d+)[ \t]+(?=\S)",
        "letter": LETTER,
    },
    "us_section_decimal": {
        "sub": r"Section[ \t]+(\d+\.\d+)[ \t]+(?=\S)",
        "top": r"Section[ \t]+(\d+)\.[ \t]+(?=\S)",
        "letter": LETTER,
    },
}
# What counts without an empty line before it. EU articles and UK schedules so end what is before them, no more.
ANYWHERE = {"eu_regulation": {"chapter", "article"}, "uk_decimal": {"schedule", "letter"}, "us_article_section": {"exhibit", "lettered", "sub", "letter"}, "us_section_decimal": {"letter"}}
# Fixed value: where a term is defined.
DEFINITION = r"([\"'])([^\"'\n]{1,120}?)\1\s+(?:means|shall mean|refers to)\b"
# Fixed value: what ends a paragraph.
BLANK_LINE = r"\n[ \t]*\n"
# What stands between the numbers of a list, and numbers of clauses and sections.
LIST_SEPARATOR = r"(?:\s*,)?(?:\s+(?:and|&|through))?\s*"
CLAUSE_NUMBER = r"\d+(?:\.\d+)?(?:\([a-z]\))?"
SECTION_NUMBER = r"\d+\.\d+(?:\([a-z]\))?"
# References to other texts, of any style.
EXTERNAL_PHRASES = [
    (r"the\s+Data\s+Protection\s+Act\s+2018", "external_statute"),
    (r"Regulation\s*\(EU\)\s*2016/679", "external_statute"),
    (r"\b(?:the|an|any)\s+applicable\s+Order\s+Form|\b(?:the|an|any)\s+Order\s+Form", "external_document"),
]
# References within a text by style, as (pattern, number in the list of its first group or None, kind, how the
# target's identifier is made). Of two that stand in one place the first counts.
REFERENCES: dict[str, list[tuple[str, str | None, str, str]]] = {
    "uk_decimal": [
        (rf"\b[Cc]lauses?\b\s+((?:{CLAUSE_NUMBER}{LIST_SEPARATOR})+)", CLAUSE_NUMBER, "internal_clause", "number"),
        (r"(?i)\bparagraphs?\s+(\d+(?:\.\d+)?)\s+of\s+Schedule\s+(\d+)\b", None, "internal_schedule", "paragraph_of_schedule"),
        (r"(?i)\bparagraphs?\s+(\d+(?:\.\d+)?)\s+(?:above|below)\b", None, "internal_schedule", "paragraph_here"),
        (r"\bSchedule\s+(\d+)\b", None, "internal_schedule", "schedule"),
    ],
    "eu_regulation": [(r"\bArticle\s+(\d+)\b", None, "internal_clause", "article")],
    "us_article_section": [
        (r"\bArticle\s+([IVXLCDM]+)\b", None, "internal_clause", "roman_article"),
        (rf"\bSections?\s+((?:{SECTION_NUMBER}{LIST_SEPARATOR})+)", SECTION_NUMBER, "internal_clause", "section"),
    ],
    "us_section_decimal": [(rf"\bSections?\s+((?:{CLAUSE_NUMBER}{LIST_SEPARATOR})+)", CLAUSE_NUMBER, "internal_clause", "section")],
}


def heading(text: str, sentence: bool = False, limit: int = 120) -> str:
    """A heading on one line, without dashes and colons around it; of a sentence, what is before its first stop."""
    flat = " ".join(text.split())
    stop = re.search(r"\.(?=\s|$)", flat[:limit]) if sentence else None
    if stop and stop.start():
        flat = flat[: stop.start()]
    return flat.strip(" \t-–—:")[:limit]


@dataclass
class Mark:
    """A line that may open a clause."""

    kind: str
    found: re.Match
    at: int
    end: int
    fresh: bool


_MARKS = {style: {kind: re.compile(rule) for kind, rule in rules.items()} for style, rules in MARKS.items()}
_BLANK = re.compile(BLANK_LINE)


def marks(text: str, style: str) -> Iterator[Mark]:
    """In order; a line is one kind at most. A paragraph starts with the text and after an empty line: two line feeds, so a
    line of white space doesn't do."""
    rules, anywhere = _MARKS[style], ANYWHERE[style]
    at, empty = 0, False
    for line in text.split("\n"):
        fresh = at == 0 or (empty and at > 1)
        for kind, rule in rules.items():
            if (fresh or kind in anywhere) and (m := rule.match(line)):
                yield Mark(kind, m, at, at + m.end(), fresh)
                break
        at, empty = at + len(line) + 1, not line


class Reader:
    """What the styles share: places of zones and headings, and items of lists."""

    def __init__(self, text: str, style: str):
        self.text, self.found, self.size = text, list(marks(text, style)), len(text)
        stop = next((i for i, m in enumerate(self.found) if m.kind == "exhibit"), None)
        if stop is not None:
            self.size, self.found = self.found[stop].at, self.found[:stop]
        self.owner: str | None = None
        self._letter: str | None = None

    def ends(self, *kinds: str) -> list[int]:
        """Of each mark where the next one of these kinds begins, or the end of what is read."""
        out, last = [], self.size
        for mark in reversed(self.found):
            out.append(last)
            if mark.kind in kinds:
                last = mark.at
        return out[::-1]

    def paragraph(self, start: int, stop: int) -> str:
        blank = _BLANK.search(self.text, start, stop)
        return self.text[start : blank.start() if blank else stop]

    def line_after(self, mark: Mark) -> str:
        start = mark.end + (self.text[mark.end : mark.end + 1] == "\n")
        return self.text[start:].split("\n", 1)[0] if start < len(self.text) else ""

    def own(self, owner: str | None) -> None:
        """Items that follow are the owner's, from the first letter on."""
        self.owner, self._letter = owner, None

    def item(self, mark: Mark, stop: int) -> Iterator[dict]:
        """A list begins with (a) after an empty line, and goes on with the next letter."""
        letter = mark.found[1]
        if self.owner is None:
            return
        if (mark.fresh and letter == "a") or letter == self._letter:
            self._letter = chr(ord(letter) + 1)
            yield clause(mark, f"{self.owner}({letter})", 3, self.owner, heading(self.paragraph(mark.end, stop)), mark.at + mark.found.start(1) - 1)
        else:
            self._letter = None


def clause(mark: Mark, identifier: str, level: int, parent: str | None, title: str, start: int | None = None) -> dict:
    return {"identifier": identifier, "level": level, "parent": parent, "g_start": mark.at if start is None else start, "marker_end": mark.end, "heading": title}


def _eu_regulation(r: Reader) -> Iterator[dict]:
    """Recitals up to the first chapter; an article's items up to the next article, whatever stands between."""
    chapter = article = None
    recitals, stops = True, r.ends("article")
    for mark, stop in zip(r.found, stops):
        number = mark.found[1]
        if mark.kind == "chapter":
            recitals = False
            if mark.fresh:
                chapter = f"chapter_{roman(number)}"
                yield clause(mark, chapter, 1, None, heading(r.line_after(mark)))
        elif mark.kind == "article":
            article = f"article_{number}" if mark.fresh else None
            if article:
                yield clause(mark, article, 2, chapter, heading(r.line_after(mark)))
        elif mark.kind == "recital" and recitals:
            yield clause(mark, f"recital_{number}", 1, None, heading(r.paragraph(mark.end, r.size)))
        elif mark.kind == "item" and article:
            yield clause(mark, f"{article}_{number}", 3, article, heading(r.paragraph(mark.end, stop)))


def _uk_decimal(r: Reader) -> Iterator[dict]:
    """The body up to the first schedule, with lists; then schedules with two levels and no lists."""
    schedule: str | None = None
    top, body = None, True
    for mark, stop, stop_item in zip(r.found, r.ends("schedule"), r.ends("schedule", "top", "sub")):
        number = mark.found[1]
        if mark.kind == "letter":
            yield from r.item(mark, stop_item)
            continue
        r.own(None)
        if mark.kind == "schedule":
            body, top = False, None
            schedule = f"schedule_{number}" if mark.fresh else None
            if schedule:
                yield clause(mark, schedule, 1, None, heading(mark.found[2]))
        elif body or schedule:
            name = number if body else f"{schedule}.{number}"
            title = heading(r.paragraph(mark.end, stop))
            if mark.kind == "top":
                top = name
                yield clause(mark, name, 1 if body else 2, schedule, title)
            else:
                yield clause(mark, name, 2 if body else 3, top, title)
                r.own(name if body else None)


def _us_article_section(r: Reader) -> Iterator[dict]:
    """Up to the first exhibit. Sections count anywhere, and only sections end a list."""
    article = None
    for mark, stop in zip(r.found, r.ends("sub", "lettered")):
        if mark.kind == "article":
            article = f"article_{roman(mark.found[1])}"
            yield clause(mark, article, 1, None, heading(r.line_after(mark)))
        elif mark.kind == "letter":
            yield from r.item(mark, stop)
        else:
            section, title = f"section_{mark.found[1]}", heading(r.paragraph(mark.end, r.size), sentence=True)
            if mark.kind == "sub":
                yield clause(mark, section, 2, article, title)
                r.own(section)
            else:
                yield clause(mark, f"{section}({mark.found[2]})", 3, section, title)
                r.own(None)


def _us_section_decimal(r: Reader) -> Iterator[dict]:
    top = None
    for mark, stop in zip(r.found, r.ends("sub", "top")):
        if mark.kind == "letter":
            yield from r.item(mark, stop)
            continue
        section, title = f"section_{mark.found[1]}", heading(r.paragraph(mark.end, r.size), sentence=mark.kind == "sub")
        if mark.kind == "top":
            top = section
            yield clause(mark, section, 1, None, title)
            r.own(None)
        else:
            yield clause(mark, section, 2, top, title)
            r.own(section)


_READ = {"eu_regulation": _eu_regulation, "uk_decimal": _uk_decimal, "us_article_section": _us_article_section, "us_section_decimal": _us_section_decimal}


def clauses(text: str, style: str) -> list[dict]:
    """Clauses in order: identifier, level, parent, g_start, marker_end, heading."""
    return list(_READ[style](Reader(text, style)))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, raw>> of what a pattern finds: with n finds a text is n + 1 pieces, whose lengths add up."""
    pattern = f"(?U){pattern}"

    def placed(raws: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(raws)), raws, lambda piece, raw: F.length(piece) + F.length(raw))
        return let(piece_starts(both, F.lit(0)), lambda starts: F.zip_with(F.zip_with(starts, both, lambda a, n: a + n), raws, lambda end, raw: F.struct((end - F.length(raw)).alias("start"), raw.alias("raw"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def extracted(docs: DataFrame) -> DataFrame:
    """docs: document_id, text, numbering_style. Adds the array clauses and n_chars, one row for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["clauses"] = [clauses(text or "", style) for text, style in zip(pdf["text"], pdf["numbering_style"])]
            pdf["n_chars"] = pdf["text"].map(lambda t: len(t or ""))
            yield pdf

    kind = docs.schema["document_id"].dataType.simpleString()
    clause = "array<struct<identifier:string,level:int,parent:string,g_start:bigint,marker_end:bigint,heading:string>>"
    return docs.select("document_id", "text", "numbering_style").mapInPandas(run, f"document_id {kind}, text string, numbering_style string, clauses {clause}, n_chars bigint")


def clause_table(found: DataFrame) -> DataFrame:
    from spanlab.operators.spans import finalized

    rows = found.select("document_id", "n_chars", F.explode("clauses").alias("c")).select("document_id", "n_chars", "c.*")
    return finalized(rows).withColumn("is_top_level", F.col("level") == 1).drop("n_chars", "marker_end")


def term_table(docs: DataFrame) -> DataFrame:
    """docs: document_id, text. Each definition with its span: to the end of its paragraph, or to the next definition."""
    size = F.length("text").alias("n_chars")
    sites = docs.select("document_id", size, F.explode(occurrences(F.col("text"), DEFINITION)).alias("s"))
    sites = sites.select("document_id", "n_chars", F.col("s.start").alias("at"), F.regexp_extract("s.raw", f"(?U){DEFINITION}", 2).alias("term"))
    breaks = docs.select("document_id", size, F.explode(occurrences(F.col("text"), BLANK_LINE)).alias("s")).select("document_id", "n_chars", F.col("s.start").alias("at"), F.lit(None).cast("string").alias("term"))
    # From the end of a document to its start, so that what follows a place has been seen.
    seen = Window.partitionBy("document_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    paragraph = F.last(F.when(F.col("term").isNull(), F.col("at")), ignorenulls=True).over(seen)
    following = F.last(F.when(F.col("term").isNotNull(), F.col("at")), ignorenulls=True).over(seen)
    rows = sites.unionByName(breaks).withColumn("stop", F.least(F.coalesce(paragraph, "n_chars"), F.coalesce(following, "n_chars"))).where("term is not null")
    return rows.select("document_id", "term", F.col("at").cast("bigint").alias("definition_start"), F.greatest(F.col("at") + 1, F.col("stop")).cast("bigint").alias("definition_end"))


def _candidates(docs: DataFrame, rule: int, pattern: str, number: str | None, kind: str, target: str | None) -> DataFrame:
    """What one rule finds: document_id, ref_start, raw_text, kind, rule, how its target is made and from which numbers."""
    found = docs.select("document_id", F.explode(occurrences(F.col("text"), pattern)).alias("s")).select("document_id", "s.start", "s.raw")
    if number is None:
        groups = 0 if target is None else re.compile(pattern).groups
        parts = F.array(*[F.regexp_extract("raw", f"(?U){pattern}", k + 1) for k in range(groups)]) if groups else F.array().cast("array<string>")
        rows = found.withColumn("parts", parts)
    else:  # the list ends where the find ends
        listed = found.withColumn("list", F.regexp_extract("raw", f"(?U){pattern}", 1))
        listed = listed.withColumn("start", F.col("start") + F.length("raw") - F.length("list"))
        rows = listed.select("document_id", "start", F.explode(occurrences(F.col("list"), number)).alias("t"))
        rows = rows.select("document_id", (F.col("start") + F.col("t.start")).alias("start"), F.col("t.raw").alias("raw"), F.array("t.raw").alias("parts"))
    return rows.select("document_id", F.col("start").cast("bigint").alias("ref_start"), F.col("raw").alias("raw_text"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.lit(target).cast("string").alias("made"), "parts")


def reference_table(found: DataFrame) -> DataFrame:
    """found: as `extracted` gives it. References that no clause's marker overlaps, each place once: document_id, raw_text,
    ref_start, target (null if it isn't a clause) and kind."""
    rules = [(None, p, None, kind, None) for p, kind in EXTERNAL_PHRASES]
    rules += [(style, *r) for style, own in REFERENCES.items() for r in own]
    rows = None
    for k, (style, *rule) in enumerate(rules):
        own = _candidates(found if style is None else found.where(F.col("numbering_style") == style), k, *rule)
        rows = own if rows is None else rows.unionByName(own)
    clauses_ = found.select("document_id", F.inline("clauses")).select("document_id", "identifier", "g_start", "marker_end")
    markers = clauses_.select("document_id", F.col("g_start").alias("m_start"), F.col("marker_end").alias("m_end"))
    overlaps = (F.col("ref_start") < F.col("m_end")) & (F.col("m_start") < F.col("ref_start") + F.length("raw_text")) & (F.col("r.document_id") == F.col("m.document_id"))
    rows = rows.alias("r").join(markers.alias("m"), overlaps, "left_anti")
    first = Window.partitionBy("document_id", "ref_start", "raw_text").orderBy("rule")
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    # The schedule that a reference stands in: the last one that opens before it.
    schedules = clauses_.where(F.col("identifier").rlike(r"^schedule_\d+$")).select("document_id", F.col("g_start").alias("ref_start"), F.col("identifier").alias("opens"))
    line = rows.unionByName(schedules, allowMissingColumns=True)
    # Strictly before: at one place a reference comes first.
    order = Window.partitionBy("document_id").orderBy("ref_start", F.col("opens").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    rows = line.withColumn("here", F.last("opens", ignorenulls=True).over(order)).where("rule is not null")
    a, b = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    name = {
        "number": a,
        "paragraph_of_schedule": F.concat(F.lit("schedule_"), b, F.lit("."), a),
        "paragraph_here": F.concat("here", F.lit("."), a),
        "schedule": F.concat(F.lit("schedule_"), a),
        "article": F.concat(F.lit("article_"), a),
        "roman_article": F.concat(F.lit("article_"), roman_to_int(F.lower(a)).cast("string")),
        "section": F.concat(F.lit("section_"), a),
    }
    wanted = F.coalesce(*[F.when(F.col("made") == k, v) for k, v in name.items()])
    known = clauses_.select("document_id", F.col("identifier").alias("target")).distinct()
    rows = rows.withColumn("wanted", wanted).join(known.withColumn("wanted", F.col("target")), ["document_id", "wanted"], "left")
    return rows.select("document_id", "raw_text", "ref_start", "target", "kind")


#: How a target's identifier is made from the numbers of a reference; here is the schedule that it stands in.
TARGETS: dict[str, Callable[[list[str], str], str]] = {
    "number": lambda n, here: n[0],
    "paragraph_of_schedule": lambda n, here: f"schedule_{n[1]}.{n[0]}",
    "paragraph_here": lambda n, here: f"{here}.{n[0]}" if here else n[0],
    "schedule": lambda n, here: f"schedule_{n[0]}",
    "article": lambda n, here: f"article_{n[0]}",
    "roman_article": lambda n, here: f"article_{roman(n[0])}",
    "section": lambda n, here: f"section_{n[0]}",
}
_PHRASES = [re.compile(p) for p, _ in EXTERNAL_PHRASES]
_REFERENCES = {style: [(re.compile(p), None if n is None else re.compile(n), made) for p, n, _, made in rules] for style, rules in REFERENCES.items()}


def references(text: str, style: str) -> list[tuple[int, str, str | None]]:
    """Of one text, as a chunker sees it: (start, what is written, identifier that it names, null for other texts), in order.
    As in `reference_table`, but a target need not be there."""
    found = clauses(text, style)
    starts = [c["g_start"] for c in found]
    schedules = [(c["g_start"], c["identifier"]) for c in found if re.fullmatch(r"schedule_\d+", c["identifier"])]
    out: dict[tuple[int, str], str | None] = {}

    def keep(start: int, raw: str, target: str | None) -> None:
        before = bisect.bisect_left(starts, start + len(raw)) - 1
        if before < 0 or found[before]["marker_end"] <= start:
            out.setdefault((start, raw), target)

    for rule in _PHRASES:
        for m in rule.finditer(text):
            keep(m.start(), m[0], None)
    for rule, number, made in _REFERENCES[style]:
        for m in rule.finditer(text):
            here = next((name for at, name in reversed(schedules) if at < m.start()), "")
            if number is None:
                keep(m.start(), m[0], TARGETS[made](list(m.groups()), here))
            else:
                for one in number.finditer(m[1]):
                    keep(m.start(1) + one.start(), one[0], TARGETS[made]([one[0]], here))
    return [(start, raw, target) for (start, raw), target in sorted(out.items(), key=lambda x: x[0])]


def drift(fresh: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks."""
    return fresh.exceptAll(committed).withColumn("side", F.lit("fresh")).unionByName(committed.exceptAll(fresh).withColumn("side", F.lit("committed")))
