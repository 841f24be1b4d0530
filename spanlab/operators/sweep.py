"""Passes over sorted spans: work that needs all spans of a document, one document after the other.

Both sides of a pass go through one shuffle by their document and are sorted within tasks; a task then reads them as a
stream of Arrow batches and works on whole documents, many at once. What is held is a batch and the spans of one document,
which are bounded by that document's text, a single row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of one batch of a result.
PAIRS = 1 << 16


def ordinals(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """0 for the rows of the first document, 1 for those of the next, and so on; keys are the first columns, sorted."""
    change = np.zeros(batch.num_rows, bool)
    for k in range(keys):
        column = batch.column(k)
        change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(change)


def whole_documents(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that no document is in two batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            # Where the open document ends in this batch; pieces of it are only joined up when it is complete.
            last = held[-1].slice(held[-1].num_rows - 1)
            both = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            goes_on = int(np.searchsorted(ordinals(both, keys), 1)) - 1
            if goes_on == batch.num_rows:
                held.append(batch)
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, goes_on)]).combine_chunks().to_batches()[0]
            batch, held = batch.slice(goes_on), []
        number = ordinals(batch, keys)
        at = int(np.searchsorted(number, number[-1]))
        if at:
            yield batch.slice(0, at)
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 and so on, count[0] of them, then those of first[1]."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - first, count)


def overlapping(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], pairs: int = PAIRS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of overlapping spans (starts, ends), about `pairs` at a time, in time of their number and of sorting.

    Of two spans that overlap, one starts within the other: lefts that start in a right are a stretch of the lefts in order,
    rights that start after a left's start and before its end are a stretch of the rights.
    """
    by_left, by_right = np.argsort(left[0], kind="stable"), np.argsort(right[0], kind="stable")
    starts, others = left[0][by_left], right[0][by_right]
    for spans, sought, side, order in ((right, starts, "left", by_left), (left, others, "right", by_right)):
        first = np.searchsorted(sought, spans[0], side)
        count = np.maximum(np.searchsorted(sought, spans[1], "left") - first, 0)
        ends = np.cumsum(count)
        at = 0
        while at < len(count):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + pairs, "right")))
            own, met = np.repeat(np.arange(at, to), count[at:to]), order[runs(first[at:to], count[at:to])]
            if len(own):
                yield (met, own) if side == "left" else (own, met)
            at = to


def paired(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], least: int
) -> DataFrame:
    """Rows of both sides whose spans share `least` characters or more, with overlap_chars; columns as an inner join has them."""
    own, others = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    twice = set(own) & set(others)
    if twice:
        raise ValueError(f"columns of both sides: {sorted(twice)}")
    empty = lambda rows, names: F.lit(None).cast(rows.select(F.struct(*names)).schema[0].dataType)
    side = lambda rows, span: [*keys, F.col(span[0]).cast("bigint").alias("_start"), F.col(span[1]).cast("bigint").alias("_end")]
    a = left.select(*side(left, left_span), F.struct(*own).alias("_left"), empty(right, others).alias("_right"))
    b = right.select(*side(right, right_span), empty(left, own).alias("_left"), F.struct(*others).alias("_right"))
    known = " and ".join(f"`{c}` is not null" for c in [*keys, "_start", "_end"])
    rows = a.unionByName(b).where(known).where("_start < _end").repartition(*keys).sortWithinPartitions(*keys)
    names = [*keys, *own, *others, "overlap_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_documents(batches, len(keys)):
            start, end = (batch.column(c).to_numpy() for c in ("_start", "_end"))
            # One number line for all documents, so that none needs a search of its own.
            place = ordinals(batch, len(keys)) * (int(end.max()) - int(start.min()) + 1) - int(start.min())
            is_left = pc.is_valid(batch.column("_left")).to_numpy(zero_copy_only=False)
            lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            spans = [(start[rows] + place[rows], end[rows] + place[rows]) for rows in (lefts, rights)]
            for i, j in overlapping(*spans):
                i, j = lefts[i], rights[j]
                shared = np.minimum(end[i], end[j]) - np.maximum(start[i], start[j])
                enough = shared >= least
                i, j = pa.array(i[enough]), pa.array(j[enough])
                columns = [batch.column(k).take(i) for k in range(len(keys))]
                columns += [*batch.column("_left").take(i).flatten(), *batch.column("_right").take(j).flatten()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared[enough])], names)

    types = {**{c: left.schema[c].dataType for c in [*keys, *own]}, **{c: right.schema[c].dataType for c in others}}
    fields = ", ".join(f"`{c}` {types[c].simpleString()}" for c in names[:-1])
    return rows.mapInArrow(run, f"{fields}, overlap_chars bigint")


def highest_below(node: np.ndarray, parent: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the highest value among itself and all below it, at any depth; and the nodes on or above a cycle.

    node, parent: edges by number of node, parent -1 for none; value: of each node. A node hands its value up when all its
    children have: level by level from the leaves, each edge once.
    """
    best = value.copy()
    some = parent >= 0
    node, parent = node[some], parent[some]
    order = np.argsort(node, kind="stable")
    node, parent = node[order], parent[order]
    first = np.searchsorted(node, np.arange(len(value) + 1))
    waiting = np.bincount(parent, minlength=len(value))
    ready = np.flatnonzero(waiting == 0)
    settled = np.zeros(len(value), bool)
    while len(ready):
        settled[ready] = True
        many = first[ready + 1] - first[ready]
        edges = runs(first[ready], many)
        up = parent[edges]
        np.maximum.at(best, up, np.repeat(best[ready], many))
        np.subtract.at(waiting, up, 1)
        ready = np.unique(up)[waiting[np.unique(up)] == 0] if len(up) else up
    return best, np.flatnonzero(~settled)


def within_documents(
    rows: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]], added: str, order: list[str] | None = None
) -> DataFrame:
    """rows with the columns that `work` gives for whole documents (a batch and its ordinals), whose rows are in order; added:
    their schema."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    given = rows.columns
    names = [*given, *(part.split()[0] for part in added.split(", "))]
    at = [given.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = (pa.RecordBatch.from_arrays([*(b.column(k) for k in at), *b.columns], [*(f"_{k}" for k in at), *b.schema.names]) for b in batches)
        for batch in whole_documents(front, len(keys)):
            own = batch.columns[len(keys) :]
            yield pa.RecordBatch.from_arrays([*own, *work(pa.RecordBatch.from_arrays(own, given), ordinals(batch, len(keys)))], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, f"{fields}, {added}")
