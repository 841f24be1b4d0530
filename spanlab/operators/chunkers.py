"""Chunkers: documents (document_id, text) to chunks (document_id, chunk_index, char_start, char_end, text).

Each works within its row: a document is never shuffled to be cut. Sentence splitting joins sentences with one space, so
its chunks have no offsets of their own; `locate` finds them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanlab.functions.text import SENTENCE_OR_BLANK, context_header
from spanlab.operators.clause_aware import clause_aware


def _chunk(start: Column, text: Column) -> Column:
    return F.struct(start.cast("bigint").alias("char_start"), (start + F.length(text)).cast("bigint").alias("char_end"), text.alias("text"))


def _exploded(docs: DataFrame, chunks: Column) -> DataFrame:
    """chunks: structs with their own slices, so that a document's text isn't carried with each of its chunks."""
    rows = docs.select("document_id", chunks.alias("s")).select("document_id", F.posexplode("s").alias("i", "s"))
    return rows.select("document_id", F.col("i").cast("bigint").alias("chunk_index"), "s.char_start", "s.char_end", "s.text")


def fixed_size(docs: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    if overlap:
        raise ValueError("fixed-size chunks don't overlap")
    # One pass of a pattern instead of a substring for each chunk, which would count from the start each time.
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return _exploded(docs, F.filter(F.transform(pieces, lambda p, i: _chunk(i * size, p)), lambda c: c["text"].rlike(r"\S")))


#: White space as the patterns of the evaluation have it, and the bytes of text after which a batch of chunks is passed on.
_SPACE = " \t\n\x0b\f\r"
_PASSED = 8 << 20
_TOKEN = re.compile(f"[^{_SPACE}]+")
_SENTENCE = re.compile(f"[.!?](?=[{_SPACE}])")


def _cut_in_batches(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]], errors: bool = False) -> DataFrame:
    """One pass over each text, in Arrow batches: a chunk for each span that the function gives.

    With errors there is a column `error` too: a text on which the function raises has one row, with the kind of exception
    and without a chunk, and the others are cut all the same.
    """
    kind = docs.schema["document_id"].dataType
    names = ["document_id", "chunk_index", "char_start", "char_end", "text", "error"][: 6 if errors else 5]

    def cut(text: str) -> list[tuple[int | None, int | None, int | None, str | None, str | None]]:
        try:
            return [(i, a, b, text[a:b], None) for i, (a, b) in enumerate(spans(text))]
        except Exception as problem:
            if not errors:
                raise
            return [(None, None, None, None, type(problem).__name__)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[int] = []
            rows: list[tuple] = []
            held = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = cut(text or "")
                own += [k] * len(found)
                rows += found
                held += len(text or "")
                if held >= _PASSED or k + 1 == batch.num_rows:
                    columns = [*zip(*rows)] if rows else [()] * 5
                    columns = [pa.array(x, pa.int64()) for x in columns[:3]] + [pa.array(x, pa.string()) for x in columns[3:]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), *columns][: len(names)], names)
                    own, rows, held = [], [], 0

    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind.simpleString()}, chunk_index bigint, char_start bigint, char_end bigint, text string" + (", error string" if errors else ""))


def guarded(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """The chunks of a chunker that may fail on some texts, and a row with the error for each of those."""
    return _cut_in_batches(docs, spans, errors=True)


def token_spans(text: str, window: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of tokens, each a step after the one before; the last may be shorter."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    step = window - overlap
    last = max(1, -(-(len(tokens) - overlap) // step)) if tokens else 0
    return [(tokens[i * step][0], tokens[min(i * step + window, len(tokens)) - 1][1]) for i in range(last)]


def token_window(docs: DataFrame, window: int = 64, overlap: int = 8) -> DataFrame:
    return _cut_in_batches(docs, lambda text: token_spans(text, window, overlap))


def fixed_spans(text: str, size: int) -> list[tuple[int, int]]:
    """As `fixed_size` cuts: pieces of white space alone are no chunks."""
    pieces = [(a, min(a + size, len(text))) for a in range(0, len(text), size)]
    return [(a, b) for a, b in pieces if text[a:b].strip(_SPACE)]


_SENTENCE_OR_BLANK = re.compile(SENTENCE_OR_BLANK, re.ASCII)


def sentence_texts(text: str, min_chars: int) -> list[str]:
    """As `sentence_split` gathers."""
    done, held = [], ""
    for part in _SENTENCE_OR_BLANK.split(text):
        part = part.strip(_SPACE)
        if not part:
            continue
        if held and len(held) >= min_chars:
            done.append(held)
            held = part
        else:
            held = f"{held} {part}" if held else part
    return [*done, held] if held else done


def sentence_split(docs: DataFrame, min_chars: int = 100) -> DataFrame:
    """Sentences gathered until they have min_chars; without offsets."""
    kind = docs.schema["document_id"].dataType.simpleString()
    names = ["document_id", "chunk_index", "char_start", "char_end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, index, texts, held = [], [], [], 0
            for k, text in enumerate(batch.column(1)):
                found = sentence_texts(text.as_py() or "", min_chars)
                own += [k] * len(found)
                index += range(len(found))
                texts += found
                held += sum(map(len, found))
                if held >= _PASSED or k + 1 == batch.num_rows:
                    none = pa.nulls(len(texts), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), pa.array(index, pa.int64()), none, none, pa.array(texts, pa.string())], names)
                    own, index, texts, held = [], [], [], 0

    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, chunk_index bigint, char_start bigint, char_end bigint, text string")


def sentence_spans(text: str, window: int, stride: int) -> list[tuple[int, int]]:
    """Windows of sentences, from the first's start to the last's end. A sentence's gap is before it, and only the first
    window keeps its own."""
    if not text.strip(_SPACE):
        return [(0, len(text))] if text else []
    bounds = [0, *(m.end() for m in _SENTENCE.finditer(text))]
    if text[bounds[-1] :].strip(_SPACE):
        bounds.append(len(text))
    many = len(bounds) - 1
    out = []
    for i in range(1 if many <= window else -(-(many - window) // stride) + 1):
        start, end = bounds[i * stride], bounds[min(i * stride + window, many)]
        own = text[start:end]
        out.append((start + (len(own) - len(own.lstrip(_SPACE)) if i else 0), start + len(own.rstrip(_SPACE))))
    return out


def sentence_window(docs: DataFrame, window: int = 3, stride: int = 2) -> DataFrame:
    return _cut_in_batches(docs, lambda text: sentence_spans(text, window, stride))


def recursive_spans(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Spans of a recursive character split: cut at the first separator found, keep it with the piece it opens, merge pieces
    up to size with an overlap in whole pieces, and cut pieces that are too long by the separators that follow."""
    out: list[tuple[int, int]] = []

    def emit(start: int, end: int) -> None:
        piece = text[start:end]
        left, right = len(piece) - len(piece.lstrip()), len(piece.rstrip())
        if right > left:
            out.append((start + left, start + right))

    def merge(pieces: list[tuple[int, int]]) -> None:
        held: list[tuple[int, int]] = []
        length = 0
        for a, b in pieces:
            if held and length + b - a > size:
                emit(held[0][0], held[-1][1])
                while held and (length > overlap or length + b - a > size and length > 0):
                    length -= held[0][1] - held[0][0]
                    held.pop(0)
            held.append((a, b))
            length += b - a
        if held:
            emit(held[0][0], held[-1][1])

    def cut(start: int, end: int, names: tuple[str, ...]) -> None:
        at = next((i for i, s in enumerate(names) if s == "" or text.find(s, start, end) >= 0), len(names) - 1)
        mark, later = names[at], names[at + 1 :]
        if mark == "":
            pieces = [(i, i + 1) for i in range(start, end)]
        else:
            bounds, i = [start], text.find(mark, start, end)
            while i >= 0:
                if i > bounds[-1]:
                    bounds.append(i)
                i = text.find(mark, i + len(mark), end)
            pieces = list(zip(bounds, [*bounds[1:], end]))
        good: list[tuple[int, int]] = []
        for a, b in pieces:
            if b - a < size:
                good.append((a, b))
                continue
            merge(good)
            good = []
            if later:
                cut(a, b, later)
            else:
                emit(a, b)
        merge(good)

    if text:
        cut(0, len(text), separators)
    return out


# The separators in their order.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_character(docs: DataFrame, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """A state machine over each text."""
    return _cut_in_batches(docs, lambda text: recursive_spans(text, size, overlap, separators))


REGISTRY: dict[str, tuple[Callable[..., DataFrame], dict]] = {}


def register_chunker(name: str, chunker: Callable[..., DataFrame], **parameters) -> None:
    REGISTRY[name] = (chunker, parameters)


def chunk(docs: DataFrame, strategies: list[str] | None = None, overrides: dict[str, dict] | None = None) -> DataFrame:
    """All strategies over all documents: chunk rows with their strategy."""
    unknown = set(strategies or []) - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    out = None
    for name in strategies or sorted(REGISTRY):
        chunker, parameters = REGISTRY[name]
        rows = chunker(docs, **(parameters | (overrides or {}).get(name, {}))).withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)  # some tell more of a chunk
    return out


#: The chunks of one text, for work within a row, of chunkers that need only the text.
_TEXTS: dict[Callable[..., DataFrame], Callable[..., list[str]]] = {
    fixed_size: lambda text, size=512: [text[a:b] for a, b in fixed_spans(text, size)],
    token_window: lambda text, window=64, overlap=8: [text[a:b] for a, b in token_spans(text, window, overlap)],
    sentence_split: lambda text, min_chars=100: sentence_texts(text, min_chars),
    sentence_window: lambda text, window=3, stride=2: [text[a:b] for a, b in sentence_spans(text, window, stride)],
    recursive_character: lambda text, size=512, overlap=50, separators=SEPARATORS: [text[a:b] for a, b in recursive_spans(text, size, overlap, separators)],
}


def texts_of(name: str) -> Callable[[str], list[str]]:
    """As `chunk` cuts by a strategy, but of one text."""
    chunker, parameters = REGISTRY[name]
    if chunker not in _TEXTS:
        raise ValueError(f"{name} needs more than a text")
    return partial(_TEXTS[chunker], **parameters)


def strategy_parameters(spark, overrides: dict[str, dict] | None = None) -> DataFrame:
    """The parameters as used, overrides included."""
    import json

    return spark.createDataFrame([(n, json.dumps(p | (overrides or {}).get(n, {}), sort_keys=True)) for n, (_, p) in sorted(REGISTRY.items())], "strategy string, parameters string")


def contextual(chunks: DataFrame) -> DataFrame:
    """chunks with section_hierarchy, clause_type, defined_terms, cross_references (strings, or structs with raw_text): text
    gets a header, original_text stays."""
    refs = F.col("cross_references")
    if isinstance(chunks.schema["cross_references"].dataType.elementType, StructType):
        refs = F.transform(refs, lambda r: r["raw_text"])
    header = context_header(F.col("section_hierarchy"), F.col("clause_type"), F.col("defined_terms"), refs)
    return chunks.withColumn("original_text", F.col("text")).withColumn("text", F.concat(header, F.col("text")))


def clause_contextual(docs: DataFrame, **parameters) -> DataFrame:
    """Clause-aware chunks under headers that tell their context."""
    return contextual(clause_aware(docs, **parameters))


register_chunker("fixed_size", fixed_size, size=512)
register_chunker("token_window", token_window, window=64, overlap=8)
register_chunker("sentence_split", sentence_split, min_chars=100)
register_chunker("sentence_window", sentence_window, window=3, stride=2)
register_chunker("rcts_512", recursive_character, size=512, overlap=50)
register_chunker("rcts_1024", recursive_character, size=1024, overlap=100)
register_chunker("clause_aware", clause_aware, min_chars=120, max_chars=1200)
register_chunker("contextual", clause_contextual, min_chars=120, max_chars=1200)
