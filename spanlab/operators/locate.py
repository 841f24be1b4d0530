"""Finding chunks in their document, in order: the cursor of a document is folded over its chunks.

A document's chunks of one strategy stand beside its text, in one row, and are found in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.functions.numbers import safe_ratio
from spanlab.functions.text import sanitized


def _found(text: str, piece: str, cursor: int) -> int:
    at = text.find(piece, cursor)
    return at if at >= 0 else text.find(piece)


def _affix(text: str, chunk: str, last: bool, cursor: int) -> tuple[int, int] | None:
    """The longest verbatim suffix (or prefix) of chunk that text holds, if it is half of chunk or more, sought from the
    cursor, then from 0."""
    lo, hi, best = (len(chunk) + 1) // 2, len(chunk), None
    while lo <= hi:
        n = (lo + hi) // 2
        piece = chunk[len(chunk) - n :] if last else chunk[:n]
        if piece in text:
            best, lo = piece, n + 1
        else:
            hi = n - 1
    if best is None:
        return None
    at = _found(text, best, cursor)
    return at, at + len(best)


#: Characters of a chunk's start and end by which its places are found, and the shortest such anchors; below, a text is searched.
ANCHOR, SHORTEST = 32, 8


class Places:
    """Where a document has chunks, or the longest ends of them. The anchors of all chunks are found in one pass over the text;
    what follows an anchor is then compared there alone, once for each different chunk."""

    def __init__(self, text: str, chunks: list[str], fuzzy: bool = True):
        self.text = text
        self._known: dict[str, tuple] = {}
        self.at: dict[str, list[int]] = {}
        for chunk in {c for c in chunks if self.anchored(c)}:
            size = self._anchor(chunk)
            self.at.setdefault(chunk[:size], [])
            if fuzzy:
                self.at.setdefault(chunk[-size:], [])
        if self.at:
            machine = ahocorasick.Automaton()
            for anchor, places in self.at.items():
                machine.add_word(anchor, (len(anchor), places))
            machine.make_automaton()
            for last, (size, places) in machine.iter(text):
                places.append(last + 1 - size)

    @staticmethod
    def _anchor(chunk: str) -> int:
        """Half of a chunk at most, so that every end of it that counts has the anchor."""
        return min(ANCHOR, (len(chunk) + 1) // 2)

    def anchored(self, chunk: str) -> bool:
        return self._anchor(chunk) >= SHORTEST

    @staticmethod
    def _from(places: list[int], cursor: int) -> int:
        """The first place at or after the cursor, else the first one."""
        k = bisect_left(places, cursor)
        return places[k] if k < len(places) else places[0]

    def exact(self, chunk: str, cursor: int) -> int:
        """As `_found`."""
        if not self.anchored(chunk):
            return _found(self.text, chunk, cursor)
        key = f"={chunk}"
        if key not in self._known:
            self._known[key] = ([p for p in self.at[chunk[: self._anchor(chunk)]] if self.text.startswith(chunk, p)],)
        places = self._known[key][0]
        return self._from(places, cursor) if places else -1

    def _shared(self, chunk: str, place: int, last: bool) -> int:
        """How many characters of a chunk's start stand at a place, or of its end before it."""
        text = self.text
        low, high = 0, min(len(chunk), place if last else len(text) - place)
        while low < high:
            n = (low + high + 1) // 2
            same = text.endswith(chunk[len(chunk) - n :], 0, place) if last else text.startswith(chunk[:n], place)
            low, high = (n, high) if same else (low, n - 1)
        return low

    def affix(self, chunk: str, last: bool, cursor: int) -> tuple[int, int] | None:
        """As `_affix`."""
        if not self.anchored(chunk):
            return _affix(self.text, chunk, last, cursor)
        key = f"{'>' if last else '<'}{chunk}"
        if key not in self._known:
            size = self._anchor(chunk)
            found = [(self._shared(chunk, p + size if last else p, last), p + size if last else p) for p in self.at[chunk[-size:] if last else chunk[:size]]]
            best = max((n for n, _ in found), default=0)
            enough = best >= (len(chunk) + 1) // 2
            self._known[key] = (best, [p - best if last else p for n, p in found if n == best]) if enough else (0, [])
        best, places = self._known[key]
        if not places:
            return None
        at = self._from(places, cursor)
        return at, at + best


def joined(head: tuple[int, int] | None, tail: tuple[int, int] | None, size: int) -> tuple[int, int, int] | None:
    """(start, end, covered) from the places of a chunk's longest ends: both together where the gap between them is at most
    twice the chunk, and covered is then the longer one."""
    if head and tail:
        gap = max(head[0], tail[0]) - min(head[1], tail[1])
        if gap <= 2 * size:
            return min(head[0], tail[0]), max(head[1], tail[1]), max(head[1] - head[0], tail[1] - tail[0])
    best = tail if tail and (not head or tail[1] - tail[0] >= head[1] - head[0]) else head
    return (*best, best[1] - best[0]) if best else None


def located_in(text: str, chunks: list[str], fuzzy: bool = True) -> list[tuple[int | None, int | None, int, bool]]:
    """(start, end, covered, exact) of each chunk; null where it isn't found. A chunk is sought from the cursor, then from 0."""
    places = Places(text, chunks, fuzzy)
    out, cursor = [], 0
    for chunk in chunks:
        at = places.exact(chunk, cursor) if chunk.strip() else -1
        if at >= 0:
            out.append((at, at + len(chunk), len(chunk), True))
            cursor = max(cursor, at + len(chunk))
            continue
        near = joined(places.affix(chunk, False, cursor), places.affix(chunk, True, cursor), len(chunk)) if fuzzy and chunk.strip() else None
        if near is None:
            out.append((None, None, 0, False))
            cursor = 0
        else:
            out.append((*near, False))
            cursor = max(cursor, near[1])
    return out


def sequential(text: str, chunks: list[str]) -> list[tuple[int, int, int]]:
    """(index, start, end) of the chunks that are found; others are skipped, and the cursor follows every find."""
    places = Places(text, chunks, fuzzy=False)
    out, cursor = [], 0
    for i, chunk in enumerate(chunks):
        at = places.exact(chunk, cursor)
        if at >= 0:
            out.append((i, at, at + len(chunk)))
            cursor = at + len(chunk)
    return out


def _gathered(chunks: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """document_id, strategy, document, own: a document's chunks of one strategy in order, beside its text."""
    own = F.sort_array(F.collect_list(F.struct(F.col("chunk_index").cast("bigint").alias("i"), F.col("text").alias("t"))))
    gathered = chunks.groupBy("document_id", "strategy").agg(own.alias("own"))
    return gathered.join(docs.select("document_id", text.alias("document")), "document_id").select("document_id", "strategy", "document", "own")


def _placed(rows: DataFrame, find: Callable[[str, list[str]], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """What find gives for each document's text and chunks: document_id, strategy and a row for each of its tuples, of which the
    first is the chunk's number in order and the others are as in schema."""
    kind = rows.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (document, own) in enumerate(zip(batch.column(2), batch.column(3))):
                texts = own.values.field("t").fill_null("").to_pylist()
                found = find(document.as_py() or "", texts)
                at = pa.array([row[0] for row in found], pa.int64())
                same = pa.array([k] * len(found), pa.int64())
                columns = [batch.column(0).take(same), batch.column(1).take(same), own.values.field("i").take(at), own.values.field("t").take(at)]
                rest = [pa.array(x) for x in zip(*(row[1:] for row in found))] if found else []
                if found:
                    yield pa.RecordBatch.from_arrays([*columns, *[x.cast(pa.bool_() if n == "exact" else pa.int64()) for n, x in zip(names, rest)]], ["document_id", "strategy", "chunk_index", "text", *names])

    return rows.mapInArrow(run, f"document_id {kind}, strategy string, chunk_index bigint, text string, {schema}")


#: Spans of chunks as they are found.
_SPAN = "char_start bigint, char_end bigint"


def located(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks (document_id, strategy, chunk_index, text) with char_start, char_end, covered_chars, exact in docs' texts, which
    are sanitised first (chunks aren't)."""

    def find(text: str, own: list[str]) -> list[tuple]:
        return [(i, *row) for i, row in enumerate(located_in(text, own))]

    return _placed(_gathered(chunks, docs, sanitized(F.col("text"))), find, ["char_start", "char_end", "covered_chars", "exact"], f"{_SPAN}, covered_chars bigint, exact boolean")


def located_exactly(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """As `located` for chunks that are substrings of the text as it is; others stay null and reset the cursor."""

    def find(text: str, own: list[str]) -> list[tuple]:
        return [(i, start, end) for i, (start, end, _, _) in enumerate(located_in(text, own, fuzzy=False))]

    return _placed(_gathered(chunks, docs, F.col("text")), find, ["char_start", "char_end"], _SPAN)


def located_sequentially(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks that `sequential` finds, with their spans."""
    return _placed(_gathered(chunks, docs, F.col("text")), sequential, ["char_start", "char_end"], _SPAN).drop("text")


def localization(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: as `located` gives them. The share of chunks that were found, and of their characters that were."""
    rate = F.coalesce(F.avg(F.col("char_start").isNotNull().cast("double")), F.lit(0.0))
    return rows.groupBy(*by).agg(rate.alias("localization_rate"), safe_ratio(F.sum("covered_chars"), F.sum(F.length("text"))).alias("localization_coverage"))
