"""Chat formatting: conversations become token sequences with control ids and a loss mask, and can be read back from those.

Token-level assembly: roles and texts are encoded as segments, each by itself, so no token spans a border; control ids that
the vocabulary doesn't have are spliced between them, `start role separator text end` for each turn. The loss mask comes
from prefix sums: the lengths of segments, summed up, are their places; a one at the start and a minus one at the end of
each text to be learnt, summed up, are the mask. Text that spells a control string never becomes a control id, since
segments are encoded as ordinary text; for readers of the rendered string it is escaped too: a backslash goes between `<`
and `|`, after any backslashes that stand there already, and `unescaped` takes exactly one out again.

A row of the result is a block of a conversation: whole turns, in order, up to about `block_bytes` of text. Rows are dealt
and sorted by ranges of (conversation, turn), and each task assembles them as they stream by, so a conversation of any
length is spread over tasks and never held as a whole. Blocks of one conversation are in the order of `place`; `whole`
tells that a block surely is its conversation's only one.

`read_back` parses blocks without other knowledge. Whole blocks are digested where they are; of conversations with several
blocks the turns meet in their order, in one task for each such conversation that holds one batch of blocks at a time: a
SHA-256 has to be taken in order.

Defined cases: turns are in the order of turn, nulls first, those of one turn by the MD5 of role, line feed and text; null
roles and texts count as empty; rows without a conversation are one conversation; repeated rows are turns each; other
columns aren't read, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order of the ids that they get, which follow those of the vocabulary.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_encodings: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    """A byte-level vocabulary from its file of ranks, once a worker, without any control string."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def assembled(
    turns: list[tuple[str, str]], encode: Callable[[str], list[int]], first: int, learnt: frozenset[str]
) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of turns (role, text); first is the id of the first control string."""
    segments: list[list[int]] = []
    marked: list[bool] = []
    for role, text in turns:
        segments += [[first], encode(escaped(role)), [first + 1], encode(escaped(text)), [first + 2]]
        marked += [False, False, False, role in learnt, False]
    stops = np.concatenate(([0], np.cumsum([len(s) for s in segments], dtype=np.int64)))
    ids = np.fromiter((i for s in segments for i in s), np.int32, int(stops[-1]))
    change = np.zeros(len(ids) + 1, np.int8)
    own = np.flatnonzero(marked)
    np.add.at(change, stops[own], 1)
    np.add.at(change, stops[own + 1], -1)
    return ids, np.cumsum(change[:-1], dtype=np.int8)


def disassembled(
    ids: np.ndarray, mask: np.ndarray, decode: Callable[[list[int]], str], first: int
) -> Iterator[tuple[str, str, str, int]]:
    """Of each turn its role, text, what the mask holds of it, and its length as a rendered string."""
    at = np.flatnonzero(ids >= first)
    if len(at) % 3 or (ids[at] - first != np.tile([0, 1, 2], len(at) // 3)).any():
        raise ValueError("control ids aren't in the order of turns")
    for start, separator, end in at.reshape(-1, 3):
        role, text = decode(ids[start + 1 : separator].tolist()), decode(ids[separator + 1 : end].tolist())
        learnt = ids[start : end + 1][mask[start : end + 1] == 1].tolist()
        yield unescaped(role), unescaped(text), unescaped(decode(learnt)), sum(map(len, CONTROLS)) + len(role) + len(text)


_BLOCK = ["place", "whole", "ids", "loss_mask"]


def _blocks(path: str, pattern: str, learnt: frozenset[str], block_bytes: int):
    """Rows (id, place, role, text) in order of place to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        encode, first = encoding.encode_ordinary, encoding.n_vocab
        owner: pa.Array | None = None  # the conversation that is open, as an array of one
        held: list[tuple[str, str]] = []
        place, size, alone = "", 0, False

        def block(whole: bool) -> pa.RecordBatch:
            ids, mask = assembled(held, encode, first, learnt)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (ids, mask)]
            return pa.RecordBatch.from_arrays([owner, pa.array([place]), pa.array([whole]), *lists], ["id", *_BLOCK])

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)))
            for k, (key, at, role, text) in enumerate(rows):
                fresh = owner is None or owner[0].as_py() != key
                if held and (fresh or size >= block_bytes):
                    yield block(alone and fresh)
                    held, size, alone = [], 0, fresh  # a task's first and last conversation may go on in others
                if fresh:
                    owner = batch.column(0).slice(k, 1)
                if not held:
                    place = at.as_py()
                held.append((role.as_py(), text.as_py()))
                size += len(held[-1][0]) + len(held[-1][1])
        if held:
            yield block(False)

    return run


def chat_formatted(
    conversations: DataFrame, ranks_path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", learnt: tuple[str, ...] = ("assistant",), block_bytes: int = 1 << 17,
) -> DataFrame:
    """Blocks of conversations: conv_col, place, whole, ids (array of int) and loss_mask (1 where a text is to be learnt)."""
    said = {c: F.coalesce(conversations[col].cast("string"), F.lit("")).alias(c) for c, col in (("role", role_col), ("text", text_col))}
    rows = conversations.select(conversations[conv_col].alias("id"), conversations[turn_col].cast("bigint").alias("turn"), *said.values())
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    # In the order of signed numbers, nulls first.
    turn = F.when(F.col("turn").isNull(), F.lit("")).otherwise(sixteen(F.col("turn").bitwiseXOR(F.lit(-(1 << 63)))))
    place = F.concat(sixteen(F.xxhash64(F.col("id").isNull(), "id")), turn, F.lit(" "), F.md5(F.concat_ws("\n", "role", "text")))
    rows = rows.select("id", place.alias("place"), "role", "text").repartitionByRange("place").sortWithinPartitions("place", "id")
    kind = rows.schema["id"].dataType.simpleString()
    run = _blocks(ranks_path, pattern, frozenset(learnt), block_bytes)
    blocks = rows.mapInArrow(run, f"id {kind}, place string, whole boolean, ids array<int>, loss_mask array<tinyint>")
    return blocks.withColumnRenamed("id", conv_col)


def _read(path: str, pattern: str):
    """A block to its turns; only of those that aren't whole are the texts handed on."""
    names = ["id", "place", "n_turns", "said", "learnt", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    numbers = {"n_turns", "loss_chars", "formatted_chars"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)

        def decode(ids: list[int]) -> str:
            return encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")

        for batch in batches:
            rows: list[tuple] = []
            for whole, ids, mask in zip(*(batch.column(k) for k in (2, 3, 4))):
                turns = list(disassembled(ids.values.to_numpy(), mask.values.to_numpy(), decode, encoding.n_vocab))
                said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns).encode()
                learnt = "".join(own for *_, own, _ in turns)
                texts = (None, None) if whole.as_py() else (said, learnt.encode())
                digests = [hashlib.sha256(x).hexdigest() for x in (said, learnt.encode())] if whole.as_py() else [None, None]
                rows.append((len(turns), *texts, digests[0], len(learnt), digests[1], sum(n for *_, n in turns)))
            columns = [*zip(*rows)] if rows else [()] * 7
            kinds = [pa.int64() if n in numbers else pa.binary() if n in ("said", "learnt") else pa.string() for n in names[2:]]
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_read`, sorted by conversation and place: one row for each conversation."""
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row(owner: pa.Array, n: int, said: str, chars: int, learnt: str, rendered: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([owner, *(pa.array([x]) for x in (n, said, chars, learnt, rendered))], names)

    owner, sums, digests = None, [0, 0, 0], []
    for batch in batches:
        done = pc.is_valid(batch.column("turns_sha256"))
        if pc.any(done).as_py():
            yield batch.filter(done).select(names)
        rest = batch.filter(pc.invert(done))
        for k, key in enumerate(rest.column("id").to_pylist()):
            if owner is None or owner[0].as_py() != key:
                if owner is not None:
                    yield row(owner, sums[0], digests[0].hexdigest(), sums[1], digests[1].hexdigest(), sums[2])
                owner, sums, digests = rest.column("id").slice(k, 1), [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
            for digest, name in zip(digests, ("said", "learnt")):
                digest.update(rest.column(name)[k].as_py())
            sums = [a + rest.column(c)[k].as_py() for a, c in zip(sums, ("n_turns", "loss_chars", "formatted_chars"))]
    if owner is not None:
        yield row(owner, sums[0], digests[0].hexdigest(), sums[1], digests[1].hexdigest(), sums[2])


def read_back(blocks: DataFrame, ranks_path: str, pattern: str, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation, from blocks alone: n_turns, turns_sha256 (of role, line feed, text, line feed of each
    turn), loss_chars and loss_sha256 (of all that the mask holds, unescaped), formatted_chars (of the rendered string)."""
    kind = blocks.schema[conv_col].dataType.simpleString()
    given = blocks.select(blocks[conv_col].alias("id"), *_BLOCK)
    columns = "turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    rows = given.mapInArrow(_read(ranks_path, pattern), f"id {kind}, place string, n_turns bigint, said binary, learnt binary, {columns}")
    met = rows.repartition("id").sortWithinPartitions("id", "place")
    return met.mapInArrow(_digested, f"id {kind}, n_turns bigint, {columns}").withColumnRenamed("id", conv_col)


def rendered(blocks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds formatted, the string of each block: control strings, and texts with control strings escaped."""
    names = [f.name for f in blocks.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        control = {encoding.n_vocab + k: mark.encode() for k, mark in enumerate(CONTROLS)}
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                parts = (control.get(i) or encoding.decode_single_token_bytes(i) for i in ids.as_py())
                out.append(b"".join(parts).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "formatted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.mapInArrow(run, f"{fields}, formatted string")
