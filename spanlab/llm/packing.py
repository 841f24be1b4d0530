"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Pieces and gaps are sorted by size into
ranges, as runs of equals (a length has one run of pieces whatever their number; a run of gaps is a stretch of sequences).
A round is a Spark job over the ranges:

1. Each range sweeps its runs from the largest size down: a piece looks up its successor, the smallest gap that holds it,
   and a run of pieces that meets a run of gaps takes places by rank, the piece of rank r the r-th place, so no two ask for
   the same one. What stays smaller than the gap goes back into the sweep while it lies in the range.
2. Pieces whose successor lies in a higher range meet the gaps that are left there, again by rank.
3. All other gaps are updated and dealt to their new ranges for the next round.

Sequences are opened as empty gaps, as many as the tokens left need at least, so an empty one is only taken where nothing
else holds a piece. Rounds end when all pieces are placed; when one places nothing, more sequences are opened. The rounds
give segments (length, ranks, places); ranks within a length are dealt in buckets, as many as the number of pieces asks
for, and pieces meet the segments of their own length and bucket.

Tokens: words between white space are tokenised on their own and kept in a bounded cache, which gives the same ids as the
whole text for this tokenizer, as its pre-tokenizer drops white space and never looks across it.

Defined cases: a null text is empty and packs as its one closing token; an empty table packs into nothing; rows that
repeat an identifier are packed as documents of their own, told apart by `copy`; a null identifier is one like any other.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm._common import written

#: Words longer than this are never cached; beyond so many words the cache is trimmed, as it is after each task, to the words
#: that came first, which are the frequent ones: an idle worker holds little, and most others never come again.
CACHED_WORD, CACHED_WORDS, KEPT_WORDS = 48, 700_000, 150_000
STRETCH = 4 << 20
#: A length's ranks are dealt in so many buckets at least.
LEAST_BUCKETS = 256

Run = tuple[int, int, int]
Segment = tuple[int, int, int, int, int, int]

_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers, by way of a cache of words."""

    def __init__(self, path: str):
        # One thread: tasks are parallel already, and threads of each worker would hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

        rules = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(r["pattern"]["Regex"] for r in rules if r["type"] == "Split"))

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined_ids(self, words: list[str], parts: list[int] | None = None) -> list[bytes]:
        """Encoded as one text and cut at the tokens that end a pre-token, of which a word has parts (one, if it is letters)."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != (sum(parts) if parts else len(words)):  # as of a letter whose lower case isn't one
            return self._ids(words)
        if parts:
            cuts = cuts[np.cumsum(parts) - 1]
        flat = ids.tobytes()
        ends = (4 * cuts).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, missing: list[str]) -> None:
        words = self.words
        stems: dict[str, None] = {}
        other: dict[str, None] = {}
        made = []
        for w in missing:
            # A stop after letters is a token of its own, and capitals are lowered before anything else.
            mark = w[-1] if w[-1] in ".,;:!?" else ""
            stem = w[:-1] if mark else w
            if stem.isalpha():
                low = stem.lower() if stem.isascii() else stem
                if low not in words:
                    stems[low] = None
                if mark and mark not in words:
                    other[mark] = None
                if mark or low != w:
                    made.append((w, low, mark))
            else:
                other[w] = None
        words.update(zip(stems, self._joined_ids(list(stems))))
        plain = [w for w in other if w.isascii() and "<|" not in w]
        words.update(zip(plain, self._joined_ids(plain, [len(self.split.findall(w.lower())) for w in plain])))
        rare = [w for w in other if w not in words]
        words.update(zip(rare, self._ids(rare)))
        for w, low, mark in made:
            words[w] = words[low] + words[mark] if mark else words[low]

    def trim(self) -> None:
        if len(self.words) > KEPT_WORDS:
            self.words = dict(itertools.islice(self.words.items(), KEPT_WORDS))

    def _known(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache where it has them."""
        if len(self.words) > CACHED_WORDS:
            self.trim()
        found = [*map(self.words.get, distinct)]
        gaps = [i for i, x in enumerate(found) if x is None]
        long = [w for w in map(distinct.__getitem__, gaps) if len(w) > CACHED_WORD]
        apart = dict(zip(long, self._ids(long)))
        self._learn([w for w in map(distinct.__getitem__, gaps) if 0 < len(w) <= CACHED_WORD])
        for i in gaps:
            found[i] = apart.get(distinct[i]) if len(distinct[i]) > CACHED_WORD else self.words[distinct[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it.

        Words are cut at ASCII white space and numbered by Arrow; only distinct ones are looked up.
        """
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        own = lengths[codes]
        ends = np.cumsum(own)
        shift = (np.cumsum(lengths) - lengths)[codes] - (ends - own)
        ids = flat[np.repeat(shift, own) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.asarray(cut.offsets)[1:] - np.asarray(cut.offsets)[0]
        return ids, np.append(0, ends)[bounds]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about STRETCH bytes of text at most, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STRETCH, "right")))
        yield batch.slice(at, to - at)
        at = to


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()
    rows = ("id", "piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            for part in _stretches(batch):
                ids, ends = coder.encode(part.column(1))
                out: list[tuple[int, int, int, int, int]] = []
                for k, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                    for piece, lo in enumerate(range(a, b + 1, capacity)):
                        own = ids[lo : min(lo + capacity, b)]
                        closing = lo + capacity > b  # the end id is one more
                        digest = zlib.crc32(own.data)
                        out.append((k, piece, lo - a, len(own) + closing, zlib.crc32(end, digest) if closing else digest))
                k, *columns = np.array(out, np.int64).reshape(-1, 5).T
                columns[0] = columns[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), *map(pa.array, columns)], rows)
        coder.trim()

    return run


def swept(pieces: Iterable[Run], gaps: Iterable[Run], lowest: int, capacity: int) -> tuple[list[Segment], list[Run], list[Run]]:
    """One sweep from the largest size down. pieces: (length, first rank, how many); gaps: (size, first sequence, how many).

    Returns segments, the pieces and the gaps that are left. What remains of a filled gap goes on in the sweep down to the
    size `lowest`; below, it is for the next round.
    """
    ahead = [(-size, first, many) for size, first, many in gaps if many]
    heapq.heapify(ahead)
    offered: list[Run] = []  # gaps that hold the piece at hand, the smallest last
    segments: list[Segment] = []
    left: list[Run] = []
    later: list[Run] = []

    def put(size: int, first: int, many: int) -> None:
        if size >= lowest and size and many:
            heapq.heappush(ahead, (-size, first, many))
        elif size and many:
            later.append((size, first, many))

    for length, rank, many in sorted(pieces, reverse=True):
        while many:
            while ahead and -ahead[0][0] >= length:
                size, first, n = heapq.heappop(ahead)
                offered.append((-size, first, n))
            if not offered:
                left.append((length, rank, many))
                break
            size, first, n = offered.pop()
            places = size // length
            taken = min(many, places * n)
            segments.append((length, rank, taken, first, places, capacity - size))
            full, some = divmod(taken, places)
            used = full + bool(some)
            if used < n:
                offered.append((size, first + used, n - used))
            put(size - places * length, first, full)
            put(size - some * length, first + full, int(bool(some)))
            rank, many = rank + taken, many - taken
    later += offered + [(-size, first, many) for size, first, many in ahead]
    return segments, left, later


#: Rows of a round: kind (PIECES, GAPS or SEGMENTS), size or length, first rank or sequence, how many; of segments also
#: the first sequence, places for each sequence, and the offset of the first.
PIECES, GAPS, SEGMENTS = 0, 1, 2
ROUND = "kind int, size bigint, first bigint, many bigint, sequence bigint, places bigint, at bigint"


def _sweeper(bounds: list[int] | None, capacity: int):
    """Sweeps the rows of one range, the sizes above one bound and up to the next; without bounds the rows that all left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        told = rows[["kind", "size", "first", "many"]].to_numpy()
        pieces, gaps = ([tuple(r[1:]) for r in told[told[:, 0] == k].tolist()] for k in (PIECES, GAPS))
        lowest = capacity + 1
        if bounds is not None:
            below = bisect.bisect_left(bounds, int(told[0, 1]))
            lowest = bounds[below - 1] + 1 if below else 1
        segments, left, later = swept(pieces, gaps, lowest, capacity)
        out = [(PIECES, *r, 0, 0, 0) for r in left] + [(GAPS, *r, 0, 0, 0) for r in later] + [(SEGMENTS, *s) for s in segments]
        new = pd.DataFrame(out, columns=list(rows.columns[:7])).astype("int64").astype({"kind": "int32"})
        return pd.concat([new, rows.loc[rows["kind"] == SEGMENTS, new.columns]])

    return run


def placed(lengths: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """lengths: length, n. Segments (length, first, many, sequence, places, at) of all pieces, by rounds.

    The piece of rank first + i lies in sequence + i // places, at offset at + (i % places) * length. Each round is written
    to the shared folder. Runs are bounded by the capacity, not by the documents, and never come to the driver.
    """
    spark = lengths.sparkSession
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("sequence", "places", "at")]
    row = lambda kind, size, first, many: [F.lit(kind).alias("kind"), size.cast("bigint").alias("size"), first.cast("bigint").alias("first"), many.cast("bigint").alias("many"), *zero]
    state = written(lengths.select(*row(PIECES, F.col("length"), F.lit(0), F.col("n"))), "packing-round")
    # Ranges of about as many lengths each.
    cuts = state.agg(F.percentile_approx("size", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    segments, opened = state.where("false"), 0
    while True:
        left = state.where(F.col("kind") == PIECES).agg(F.sum(F.col("size") * F.col("many")).alias("tokens"), F.sum("many").alias("many")).first()
        if not left.many:
            return segments.select(F.col("size").alias("length"), "first", "many", "sequence", "places", "at")
        if not opened or left.many == before:
            more = -(-left.tokens // capacity)
            state = state.unionByName(spark.range(1).select(*row(GAPS, F.lit(capacity), F.lit(opened), F.lit(more))))
            opened += more
        before = left.many
        # Pieces and gaps by range, each swept for itself; then what they leave, over all ranges.
        here = sum((F.col("size") > b).cast("int") for b in bounds) if bounds else F.lit(0)
        local = state.withColumn("range", here).groupBy("range").applyInPandas(_sweeper(bounds, capacity), ROUND)
        crossed = local.groupBy().applyInPandas(_sweeper(None, capacity), ROUND)
        done = written(crossed, "packing-round")
        segments = segments.unionByName(done.where(F.col("kind") == SEGMENTS))
        state = done.where(F.col("kind") != SEGMENTS)


def packed(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 4096,
    bucket_rows: int = 1 << 21, ranges: int = 8,
) -> DataFrame:
    """One row for each piece: identifier, piece, start, length, ids_crc32, sequence_id, offset, copy."""
    if not Path(tokenizer_path).name:
        raise ValueError("a tokenizer file is needed")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = written(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), schema), "pieces")
    # Buckets by count, so that no length, however frequent, fills a task.
    buckets = max(LEAST_BUCKETS, -(-pieces.count() // bucket_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    counts = written(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    segments = placed(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity, ranges)
    below = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    # A bucket's ranks are a stretch of its length's ranks, and few segments reach into it.
    own = begins.join(segments, "length").where("first < before + n and before < first + many")
    own = written(own.select("length", "bucket", "before", "first", "many", "sequence", "places", "at"), "piece-segments")
    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order) - 1)
    found = ranked.join(own, ["length", "bucket"]).withColumn("i", F.col("nth") + F.col("before") - F.col("first")).where("i >= 0 and i < many")
    sequence = (F.col("sequence") + F.floor(F.col("i") / F.col("places"))).cast("long")
    offset = (F.col("at") + F.col("i") % F.col("places") * F.col("length")).cast("long")
    out = found.select("id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
    copy = F.row_number().over(Window.partitionBy("id", "piece").orderBy("sequence_id", "offset")) - 1
    return out.withColumn("copy", copy).withColumnRenamed("id", id_col)
