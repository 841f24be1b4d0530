"""The superseded text-overlap metrics, against the structure that the clause-aware chunker itself reports.

A document's metrics need its own clauses, terms, references and chunks and nothing of other documents, so they are one pass
over each row, in Arrow batches. What a chunk holds is found in one pass over it, and clauses meet only chunks that may have
enough of their words: pairs of chunks with clauses, terms or references are never rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.operators import extract
from spanlab.operators.terms import Passages, Phrases

KEYS = ["strategy", "document_id"]
METRICS = ["legacy_size_cv", "legacy_fragmentation", "legacy_definition_preservation", "legacy_xref_resolution", "legacy_depth_retained"]
# Words that define, and phrases that lead to a reference.
DEFINING = r"(?:means|shall\s+mean|defined\s+as|refers\s+to)"
LEADS = (r"as\s+(?:defined|set\s+(?:out|forth))\s+in\s+", r"subject\s+to\s+", r"pursuant\s+to\s+", r"in\s+accordance\s+with\s+", r"referred\s+to\s+in\s+", r"under\s+")
TARGET = r"(?:Section|Clause|Article)\s+[\d.()]+"
# Quoted terms, numbering at the start of a line, a heading with its (kind) and (number), and what may follow the
# number. Line ends are those of Spark's patterns.
QUOTED = (r'"([A-Z][A-Za-z\s]{2,30})"', r"'([A-Z][A-Za-z\s]{2,30})'")
NUMBERING = r"(?m)^(\d+(?:\.\d+)*)\."
LINE_ENDS = "\n\r\x85\u2028\u2029"
HEADING = rf"(?:\A|(?<=[{LINE_ENDS}]))[ \t]*(?:#{{1,6}}[ \t]*)?(?:(clause|section|article)[ \t]+)?([\d.()][^{LINE_ENDS}]*)"
AFTER_NUMBER = r"\Z|[ \t:—-]|\.(?!\d)|\)(?!\d)"
# Clauses this short aren't asked for.
LEAST = 20


def told(text: str = "text") -> list[Column]:
    """Quoted terms, references and numbering depth of a text."""
    quoted = F.array_union(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in QUOTED])
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?i){lead}{TARGET}"), F.lit(0)) for lead in LEADS]))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBERING), F.lit(1)), lambda x: F.size(F.split(x, r"\.")))
    depth = F.greatest(F.coalesce(F.array_max(numbers), F.lit(0)), F.lit(1))
    return [F.filter(quoted, lambda t: F.length(F.trim(t)) >= 2).alias("terms"), found.alias("refs"), depth.alias("depth")]


#: Up to so many chunks each clause that is left is compared with all of them.
FEW = 64
_NUMBER = re.compile(r"\d+(?:\.\d+)*\.?", re.ASCII)
_HEADING, _AFTER_NUMBER = re.compile(HEADING, re.ASCII | re.IGNORECASE), re.compile(AFTER_NUMBER, re.ASCII)
_TARGET = re.compile(r"(section|clause|article)\s+([\d.()]+)$", re.ASCII)


def words(text: str) -> list[bytes]:
    """In lower case, as UTF-8: only ASCII white space parts bytes, as in Spark's patterns."""
    return text.lower().encode().split()


class Truth:
    """What a document's chunks are measured against. clauses: (identifier, text)."""

    def __init__(self, clauses: list[tuple[str, str]], terms: list[str], refs: list[str], depth: int):
        self.clauses = [(name, text) for name, text in clauses if len(text.strip(" ")) >= LEAST]
        self.terms = [t.strip(" ").lower() for t in terms]
        self.refs = [*Counter(r.lower() for r in refs).items()]
        self.depth = depth

    @cached_property
    def words(self) -> list[set[bytes]]:
        return [set(words(text)) for _, text in self.clauses]

    @cached_property
    def in_full(self) -> Passages:
        return Passages([text for _, text in self.clauses])

    @cached_property
    def phrases(self) -> Phrases:
        return Phrases(self.terms)

    @cached_property
    def targets(self) -> list[tuple[str, str]]:
        """(kind, number) of each reference."""
        return [_TARGET.search(text).groups() for text, _ in self.refs]

    @cached_property
    def written(self) -> Passages:
        return Passages([text for text, _ in self.refs])


def size_cv(chunks: list[str]) -> float:
    sizes = [len(c) for c in chunks]
    total = sum(sizes)
    return math.sqrt(len(sizes) * sum(n * n for n in sizes) - total * total) / total if len(sizes) > 1 and total else 0.0


def fragmentation(chunks: list[str], truth: Truth) -> float:
    """Clauses of 20 characters or more of which no chunk has four fifths of the words. Those of one identifier are one."""
    names = {name for name, _ in truth.clauses}
    if not names:
        return 0.0
    whole = {truth.clauses[n][0] for c in chunks for n, _ in truth.in_full.first(c)}
    if len(whole) < len(names):
        rest = [(name, asked, (4 * len(asked) + 4) // 5) for (name, _), asked in zip(truth.clauses, truth.words) if name not in whole and asked]
        owns = [set(words(c)) for c in chunks]
        places: dict[bytes, list[int]] = {}
        if len(chunks) > FEW:
            places = {word: [] for _, asked, _ in rest for word in asked}
            for i, own in enumerate(owns):
                for word in own & places.keys():
                    places[word].append(i)
        for name, asked, least in rest:
            near = range(len(owns))
            if len(chunks) > FEW:  # a chunk without any of the rarest has too few of the others; those of the rarest come first
                rarest = sorted(asked, key=lambda w: len(places[w]))[: len(asked) - least + 1]
                near = (i for w in rarest for i in places[w])
            if name not in whole and any(len(owns[i]) >= least and len(asked & owns[i]) >= least for i in near):
                whole.add(name)
    return (len(names) - len(whole)) / len(names)


_DEFINING = re.compile(f"(?={DEFINING})")
_AFTER_TERM = re.compile(r"[\"']?[ \t\n\x0b\f\r]*")


def defined_in(text: str, terms: Phrases) -> set[str]:
    """The terms that a defining word follows in a text: after a quote, white space and 80 characters at most."""
    low = text.lower()
    defining = [m.start() for m in _DEFINING.finditer(low)]
    out = set()
    for at, n in terms.finds(low) if defining else ():
        end = at + len(terms.phrases[n])
        k = bisect_left(defining, end)
        if k < len(defining) and defining[k] <= _AFTER_TERM.match(low, end).end() + 80:
            out.add(terms.phrases[n])
    return out


def definition_preservation(chunks: list[str], truth: Truth) -> float:
    """Terms with a chunk in which a defining word follows within 80 characters. They are sought together, once in each chunk."""
    if not truth.terms:
        return 1.0
    kept: set[str] = set()
    for c in chunks:
        kept |= defined_in(c, truth.phrases)
        if len(kept) == len(truth.phrases.phrases):
            break
    return sum(t in kept for t in truth.terms) / len(truth.terms)


def headings(text: str) -> list[tuple[str, str]]:
    """(kind, number and what follows it) of each line that may be a target's heading; the kind may be missing."""
    return [((m[1] or "").lower(), m[2]) for m in _HEADING.finditer(text)]


def is_target(kind: str, number: str, heading: tuple[str, str]) -> bool:
    return heading[0] in ("", kind) and heading[1].startswith(number) and _AFTER_NUMBER.match(heading[1], len(number)) is not None


def reference_resolution(chunks: list[str], truth: Truth) -> float:
    """References whose chunk, or a chunk beside it, has the target as a heading."""
    if not truth.refs:
        return 1.0
    kept: set[int] = set()
    own = [headings(c) for c in chunks]
    for i, c in enumerate(chunks):
        for n, _ in truth.written.first(c.lower()):
            if n not in kept and any(is_target(*truth.targets[n], h) for near in own[max(i - 1, 0) : i + 2] for h in near):
                kept.add(n)
    return sum(truth.refs[n][1] for n in kept) / sum(many for _, many in truth.refs)


def depth_retained(chunks: list[str], truth: Truth) -> float:
    """Of the numbering's depth: a number with a stop after it is as deep as it has stops."""
    if truth.depth <= 1:
        return 1.0
    return min(max((number.count(".") for c in chunks for number in _NUMBER.findall(c)), default=0) / truth.depth, 1.0)


def measured(chunks: list[str], truth: Truth) -> tuple[float, ...]:
    """The METRICS of a document's chunks, which are in order."""
    return size_cv(chunks), fragmentation(chunks, truth), definition_preservation(chunks, truth), reference_resolution(chunks, truth), depth_retained(chunks, truth)


def _rows(docs: DataFrame, cases: Callable[..., tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]]) -> DataFrame:
    """docs: document_id, terms, refs, depth and more, of which `cases` makes the document's clauses and its chunks by strategy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, names, found = [], [], []
            for k, (_, *row) in enumerate(zip(*batch.columns)):
                terms, refs, depth, *more = (x.as_py() for x in row)
                clauses, by_strategy = cases(*more)
                truth = Truth(clauses, terms or [], refs or [], depth)
                for strategy, chunks in by_strategy:
                    if chunks:
                        own.append(k)
                        names.append(strategy)
                        found.append(measured(chunks, truth))
            columns = [pa.array(x, pa.float64()) for x in (zip(*found) if found else [()] * len(METRICS))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(0).take(pa.array(own, pa.int32())), *columns], [*KEYS, *METRICS])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"strategy string, document_id {kind}, " + ", ".join(f"{m} double" for m in METRICS))


def legacy_row_in_place(docs: DataFrame, cuts: dict[str, Callable[[str], list[str]]]) -> DataFrame:
    """docs: document_id, text, numbering_style. cuts: by strategy, the chunks of a text. Nothing is shuffled."""

    def cases(text: str | None, style: str) -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
        text = text or ""
        found = extract.clauses(text, style)
        ends = [*(c["g_start"] for c in found[1:]), len(text)]
        return [(c["identifier"], text[c["g_start"] : end]) for c, end in zip(found, ends)], [(name, cut(text)) for name, cut in cuts.items()]

    return _rows(docs.select("document_id", *told(), "text", "numbering_style"), cases)


def legacy_row(chunks: DataFrame, docs: DataFrame, clauses: DataFrame) -> DataFrame:
    """chunks: strategy, document_id, chunk_index, text. For chunks and clauses of any origin: texts go through one shuffle."""

    def cases(text: str | None, own: list[dict] | None, strategy: str, cut: list[dict]) -> tuple[list[tuple[str, str]], list[tuple[str, list[str]]]]:
        return [(c["identifier"], (text or "")[c["g_start"] : c["g_end"]]) for c in own or ()], [(strategy, [c["text"] or "" for c in cut])]

    own = clauses.groupBy("document_id").agg(F.collect_list(F.struct("identifier", "g_start", "g_end")).alias("own"))
    cut = chunks.groupBy("document_id", "strategy").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("cut"))
    rows = docs.select("document_id", *told(), "text").join(own, "document_id", "left").join(cut, "document_id")
    return _rows(rows.select("document_id", "terms", "refs", "depth", "text", "own", "strategy", "cut"), cases)
