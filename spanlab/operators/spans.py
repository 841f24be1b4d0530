"""Joins and unions of half-open spans, by sweeps over a document's sorted spans: none pairs all spans of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.operators import sweep


def overlap_join(left: DataFrame, right: DataFrame, least: int = 1, key: str = "document_id") -> DataFrame:
    """Pairs of left (char_start, char_end) and right (g_start, g_end) with at least `least` shared characters (1 or more);
    adds overlap_chars. Costs sorting and the pairs that overlap, whatever the number and length of a document's spans."""
    if least < 1:
        raise ValueError("spans that share nothing don't overlap")
    return sweep.paired(left, right, [key], ("char_start", "char_end"), ("g_start", "g_end"), least)


def section_match(ov: Column, length: Column, least: int = 100) -> Column:
    """A short section needs half of it, any other `least` characters."""
    return F.when(length < least, 2 * ov >= length).otherwise(ov >= least)


def merged_intervals(spans: DataFrame, keys: list[str], start: str = "char_start", end: str = "char_end") -> DataFrame:
    """The union of each key's spans: maximal stretches; touching ones merge."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(order))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def containment(gold: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each different gold span (keys, g_start, g_end and more): is it contained in one chunk, and how many chunks does it
    touch?

    A sweep over the starts and ends of chunks and gold spans, in order. A gold span is contained if the furthest end among
    chunks that start at or before its start isn't before its own end. It touches the chunks that start before its end, but
    for those that end at or before its start; empty spans touch nothing. One shuffle and one sort by the document.
    """
    own = [c for c in gold.columns if c not in keys]
    none = F.lit(None).cast(gold.select(F.struct(*own)).schema[0].dataType)
    filled = (F.col("char_end") > F.col("char_start")).cast("int")

    def event(at: str, turn: int, **columns: Column) -> Column:
        values = {"at": F.col(at).cast("bigint"), "turn": F.lit(turn), "reach": F.lit(None).cast("bigint"), "opens": F.lit(0), "closes": F.lit(0)}
        return F.struct(*[x.alias(name) for name, x in (values | columns).items()])

    chunks = chunks.where(" and ".join(f"`{c}` is not null" for c in [*keys, "char_start", "char_end"]))
    # At one place: ends of chunks, a gold span's end, starts of chunks, a gold span's start.
    of_chunk = F.array(event("char_end", 0, closes=filled), event("char_start", 2, opens=filled, reach=F.col("char_end").cast("bigint")))
    of_gold = F.array(event("g_end", 1), event("g_start", 3))
    events = chunks.select(*keys, none.alias("own"), F.inline(of_chunk)).unionByName(gold.select(*keys, F.struct(*own).alias("own"), F.inline(of_gold)))
    sweep_ = Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select(*keys, "own", "at", "turn", F.max("reach").over(sweep_).alias("reach"), F.sum("opens").over(sweep_).alias("opened"), F.sum("closes").over(sweep_).alias("closed"))
    asked = seen.where("own is not null")
    at_start = lambda x: F.max(F.when(F.col("turn") == 3, F.col(x)))
    before_end = F.max(F.when(F.col("turn") == 1, F.col("opened")))
    found = asked.groupBy(*keys, "own").agg(at_start("reach").alias("reach"), before_end.alias("opened"), at_start("closed").alias("closed"))
    touched = F.when(F.col("own.g_end") > F.col("own.g_start"), F.col("opened") - F.col("closed")).otherwise(0)
    contained = F.coalesce(F.col("reach") >= F.col("own.g_end"), F.lit(False))
    out = found.select(*keys, "own.*", contained.alias("contained"), touched.cast("bigint").alias("touched"))
    return out.select(*gold.columns, "contained", "touched")


def point_in_span(points: DataFrame, spans: DataFrame, key: str = "document_id", at: str = "ref_start") -> DataFrame:
    """points with each span (char_start, char_end) that they are in."""
    end = "_point_end"
    rows = points.withColumn(end, F.col(at) + 1)
    return sweep.paired(rows, spans, [key], (at, end), ("char_start", "char_end"), 1).drop(end, "overlap_chars")


def finalized(clauses: DataFrame) -> DataFrame:
    """Ends of clauses that are known by their start: the next clause's start, or the document's end (n_chars)."""
    order = Window.partitionBy("document_id").orderBy("g_start")
    return clauses.withColumn("g_end", F.coalesce(F.lead("g_start").over(order), F.col("n_chars")))


def nearest_preceding(rows: DataFrame, is_heading: Column, value: str, out: str) -> DataFrame:
    """value of the nearest heading strictly before each row, in document order."""
    order = Window.partitionBy("document_id").orderBy("g_start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(is_heading, F.col(value)), ignorenulls=True).over(order))


class CycleError(ValueError):
    """A clause is its own ancestor."""


def subtree_ends(clauses: DataFrame) -> DataFrame:
    """clauses: document_id, identifier, parent, g_end and more. Adds subtree_end, the furthest end of a clause and of all
    clauses below it, however deep.

    Parents that the document doesn't have count as none; rows that repeat an identifier are one clause with all their
    parents. A clause that is its own ancestor is a CycleError.
    """

    def work(batch: pa.RecordBatch, document: np.ndarray) -> list[pa.Array]:
        size = len(document)
        names = pa.concat_arrays([batch.column("identifier").cast(pa.string()), batch.column("parent").cast(pa.string())])
        codes = names.dictionary_encode()
        code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.tile(document, 2) * (len(codes.dictionary) + 1) + code + 1
        nodes, node = np.unique(key[:size], return_inverse=True)
        parent = np.searchsorted(nodes, key[size:])
        held = (parent < len(nodes)) & (nodes[np.minimum(parent, len(nodes) - 1)] == key[size:]) & (code[size:] >= 0)
        lowest = np.iinfo(np.int64).min
        end = batch.column("g_end").cast(pa.int64()).fill_null(lowest).to_numpy(zero_copy_only=False)
        value = np.full(len(nodes), lowest)
        np.maximum.at(value, node, end)
        best, open_ = sweep.highest_below(node, np.where(held, parent, -1), value)
        if len(open_):
            where = int(np.flatnonzero(node == open_[0])[0])
            raise CycleError(f"clause {batch.column('identifier')[where]} of document {batch.column('document_id')[where]} is in or above a cycle")
        found = best[node]
        return [pa.array(found, mask=found == lowest)]

    return sweep.within_documents(clauses, ["document_id"], work, "subtree_end bigint")


def leaves(clauses: DataFrame) -> DataFrame:
    parents = clauses.where("parent is not null").select("document_id", F.col("parent").alias("identifier")).distinct()
    return clauses.join(parents, ["document_id", "identifier"], "left_anti")
