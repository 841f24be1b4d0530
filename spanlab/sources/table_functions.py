"""The chunkers as table functions of SQL.

    table_functions.register(spark)
    SELECT document_id, c.* FROM documents, LATERAL chunk_token_window(text, 64, 8) c

Each gives the rows that the DataFrame function of the same strategy gives for a document. They run in Arrow batches beside the
row that they are applied to, so nothing is shuffled. Parameters may be left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanlab.operators import chunkers, clause_aware as A

SPANS = "chunk_index bigint, char_start bigint, char_end bigint, text string"


def _cut(text: str | None, spans: list[tuple[int, int]]) -> Iterator[tuple]:
    yield from ((i, a, b, text[a:b]) for i, (a, b) in enumerate(spans))


class FixedSize:
    def eval(self, text: str, size: int = 512):
        yield from _cut(text, chunkers.fixed_spans(text or "", size))


class TokenWindow:
    def eval(self, text: str, window: int = 64, overlap: int = 8):
        yield from _cut(text, chunkers.token_spans(text or "", window, overlap))


class SentenceSplit:
    def eval(self, text: str, min_chars: int = 100):
        yield from ((i, None, None, t) for i, t in enumerate(chunkers.sentence_texts(text or "", min_chars)))


class SentenceWindow:
    def eval(self, text: str, window: int = 3, stride: int = 2):
        yield from _cut(text, chunkers.sentence_spans(text or "", window, stride))


class RecursiveCharacter:
    def eval(self, text: str, size: int = 512, overlap: int = 50):
        yield from _cut(text, chunkers.recursive_spans(text or "", size, overlap, chunkers.SEPARATORS))


class ClauseAware:
    def eval(self, text: str, min_chars: int = 120, max_chars: int = 1200, jurisdiction: str = "uk"):
        text = text or ""
        for i, (a, b, path, kind, sure, terms, refs) in enumerate(A.described(text, A.style_of(text, jurisdiction), min_chars, max_chars)):
            yield i, a, b, text[a:b], path, kind, sure, terms, [{"raw_text": raw, "target": target} for raw, target in refs]


FUNCTIONS = {
    "chunk_fixed_size": (FixedSize, SPANS), "chunk_token_window": (TokenWindow, SPANS), "chunk_sentence_split": (SentenceSplit, SPANS),
    "chunk_sentence_window": (SentenceWindow, SPANS), "chunk_recursive_character": (RecursiveCharacter, SPANS),
    "chunk_clause_aware": (ClauseAware, ", ".join([SPANS, *(f"{n} {t}" for n, t in A.COLUMNS.items())])),
}


def register(spark: SparkSession) -> None:
    for name, (made, schema) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(made, returnType=schema, useArrow=True))
