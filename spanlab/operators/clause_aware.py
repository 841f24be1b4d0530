"""The clause-aware chunker: chunks that follow a document's numbering, with what is known of each.

A document is read by the numbering of its jurisdiction (`extract.clauses`); each clause is a unit from its mark to the next
one. A chunk is one unit, or a short one with those after it that are below or beside it; units too long are cut at
paragraphs, lines and sentences. Each chunk tells its section path, the kind of clause with a confidence, the document's
defined terms that it uses and the references that begin in it. All of that is one pass over each text, in Arrow batches.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions.text import jurisdiction as jurisdiction_of
from spanlab.operators import extract
from spanlab.operators.terms import Phrases

#: Words that tell a kind of clause. What is said of almost any clause is last, as the first of equals counts.
CUES: dict[str, tuple[str, ...]] = {
    "confidentiality": ("confidential", "confidentiality", "non-disclosure", "disclose"),
    "data_protection": ("personal data", "data subject", "data protection", "processor", "controller"),
    "definitions": ("means", "definitions", "interpretation", "shall mean", "refers to"),
    "dispute_resolution": ("arbitration", "dispute", "mediation", "arbitrator"),
    "governing_law": ("governing law", "governed by", "jurisdiction", "courts of"),
    "indemnity": ("indemnify", "indemnity", "hold harmless", "indemnification"),
    "intellectual_property": ("intellectual property", "copyright", "patent", "trade mark", "licence", "license"),
    "liability": ("liability", "liable", "damages", "limitation of liability"),
    "notices": ("notice", "notices", "in writing"),
    "payment": ("fees", "payment", "invoice", "charges", "pay"),
    "termination": ("termination", "terminate", "expiry", "notice of termination"),
    "warranty": ("warrants", "warranty", "represents", "warranties"),
    "obligation": ("shall", "must", "agrees to", "undertakes"),
}
_CUES = Phrases([cue for own in CUES.values() for cue in own])
_KIND_OF = [next(kind for kind, own in CUES.items() if cue in own) for cue in _CUES.phrases]
_DEFINITION = re.compile(extract.DEFINITION)
STYLES = {"uk": "uk_decimal", "eu": "eu_regulation"}
#: A line that names an article, in a US text.
US_ARTICLE = r"(?m)^ARTICLE[ \t]+[IVXLCDM]+[ \t]*$"
COLUMNS = {
    "section_hierarchy": "string", "clause_type": "string", "confidence": "double", "defined_terms": "array<string>",
    "cross_references": "array<struct<raw_text:string,target:string>>",
}
#: Characters of text after which a batch of chunks is passed on.
_PASSED = 8 << 20


def style_of(text: str, jurisdiction: str) -> str:
    """US texts number by articles and sections where a line names an article, else by decimal sections."""
    if jurisdiction == "us":
        return "us_article_section" if re.search(US_ARTICLE, text) else "us_section_decimal"
    return STYLES[jurisdiction]


def label(identifier: str, title: str) -> str:
    """A step of a section path: how the clause is cited, and its heading."""
    if letter := re.search(r"\([a-z]\)$", identifier):
        name = letter[0]
    elif item := re.fullmatch(r"article_\d+_(\d+)", identifier):
        name = f"paragraph {item[1]}"
    else:
        name = identifier.capitalize().replace("_", " ")
    return f"{name} {title.replace('>', ' ')[:60]}".strip()


@dataclass
class Chunk:
    start: int
    end: int
    path: tuple[str, ...]
    titles: list[str] = field(default_factory=list)


def units(text: str, style: str) -> Iterator[Chunk]:
    """What is before the first clause, then each clause, with the path from the top."""
    found = extract.clauses(text, style)
    paths: dict[str, tuple[str, ...]] = {}
    first = found[0]["g_start"] if found else len(text)
    if first:
        yield Chunk(0, first, ())
    for clause, after in zip(found, [*found[1:], {"g_start": len(text)}]):
        path = (*paths.get(clause["parent"], ()), label(clause["identifier"], clause["heading"]))
        paths[clause["identifier"]] = path
        yield Chunk(clause["g_start"], after["g_start"], path, [clause["heading"]])


def shared(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def gathered(parts: Iterator[Chunk], min_chars: int, max_chars: int) -> Iterator[Chunk]:
    """Short chunks grow by the units below or beside them; top-level clauses are never put together."""
    held: Chunk | None = None
    for part in parts:
        if held is not None:
            depth = shared(held.path, part.path)
            if held.end - held.start < min_chars and part.end - held.start <= max_chars and depth and depth >= len(held.path) - 1:
                held = Chunk(held.start, part.end, held.path[:depth], held.titles + part.titles)
                continue
            yield held
        held = part
    if held is not None:
        yield held


def kind_of(text: str, titles: list[str]) -> tuple[str | None, float | None]:
    """The kind with the highest score, the first one of equals, and its share of all scores (of one more, so that a single
    cue isn't certain). A different cue counts one, two more in a heading; a definition counts five."""
    score = dict.fromkeys(CUES, 0)
    for where, weight in ((text, 1), ("\n".join(titles), 2)):
        for cue in {n for _, n in _CUES.places(where)}:
            score[_KIND_OF[cue]] += weight
    score["definitions"] += 5 * len(_DEFINITION.findall(text))
    best = max(score, key=score.__getitem__)
    return (best, score[best] / (sum(score.values()) + 1)) if score[best] else (None, None)


def described(text: str, style: str, min_chars: int, max_chars: int) -> list[tuple]:
    """(char_start, char_end, section path, kind, confidence, terms, references) of each chunk."""
    from spanlab.operators.chunkers import SEPARATORS, recursive_spans

    terms = Phrases([m[2] for m in _DEFINITION.finditer(text)])
    used = sorted(terms.places(text))
    refs = extract.references(text, style) if text else []
    used_at, refs_at = [at for at, _ in used], [at for at, _, _ in refs]
    out = []
    for chunk in gathered(units(text, style), min_chars, max_chars):
        for a, b in recursive_spans(text[chunk.start : chunk.end], max_chars, 0, SEPARATORS):
            start, end = chunk.start + a, chunk.start + b
            here = slice(bisect.bisect_left(used_at, start), bisect.bisect_left(used_at, end))
            names = [*dict.fromkeys(terms.phrases[n] for _, n in used[here])]
            own = [(raw, target) for _, raw, target in refs[bisect.bisect_left(refs_at, start) : bisect.bisect_left(refs_at, end)]]
            out.append((start, end, " > ".join(chunk.path) or None, *kind_of(text[start:end], chunk.titles), names, own))
    return out


def clause_aware(docs: DataFrame, min_chars: int = 120, max_chars: int = 1200, jurisdiction: str | None = None) -> DataFrame:
    """Chunks with their spans and section_hierarchy, clause_type, confidence, defined_terms and cross_references.

    The jurisdiction (uk, us or eu) is the one that is given, else that of the document: its column jurisdiction, or what its
    identifier begins with.
    """
    if jurisdiction not in (None, "uk", "us", "eu"):
        raise ValueError(f"unknown jurisdiction {jurisdiction}")
    told = F.col("jurisdiction") if "jurisdiction" in docs.columns else jurisdiction_of(F.col("document_id").cast("string"))
    rows = docs.select("document_id", "text", (F.lit(jurisdiction) if jurisdiction else told).alias("jurisdiction"))
    names = ["document_id", "chunk_index", "char_start", "char_end", "text", *COLUMNS]
    reference = pa.struct([("raw_text", pa.string()), ("target", pa.string())])
    kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.float64(), pa.list_(pa.string()), pa.list_(reference)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, chunks, held = [], [], 0
            for k, (text, where) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                text = text or ""
                for i, (start, end, path, kind, sure, terms, refs) in enumerate(described(text, style_of(text, where), min_chars, max_chars)):
                    own.append(k)
                    chunks.append((i, start, end, text[start:end], path, kind, sure, terms, [{"raw_text": raw, "target": target} for raw, target in refs]))
                held += len(text)
                if held >= _PASSED or k + 1 == batch.num_rows:
                    columns = [pa.array(x, t) for x, t in zip([*zip(*chunks)] if chunks else [()] * 9, kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), *columns], names)
                    own, chunks, held = [], [], 0

    kind = docs.schema["document_id"].dataType.simpleString()
    told_of = ", ".join(f"{name} {t}" for name, t in COLUMNS.items())
    return rows.mapInArrow(run, f"document_id {kind}, chunk_index bigint, char_start bigint, char_end bigint, text string, {told_of}")
