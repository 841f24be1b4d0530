"""How faithful are chunks to the clauses of their document? One row for each strategy and document.

chunks: strategy, document_id, chunk_index, char_start, char_end, char_count (spans null if not located).
clauses: document_id, identifier, parent, g_start, g_end, is_top_level, is_leaf, subtree_end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions.numbers import overlap, safe_ratio, size_variation
from spanlab.functions.text import sanitized
from spanlab.operators.spans import overlap_join, point_in_span
from spanlab.operators.terms import Phrases, is_whole
from spanlab.session import held

KEYS = ["strategy", "document_id"]


def located(chunks: DataFrame) -> DataFrame:
    return chunks.where("char_start is not null and char_end is not null")


def fragmentation(chunks: DataFrame, clauses: DataFrame, least: int = 20) -> DataFrame:
    """Share of leaf clauses (of `least` characters or more) that no single chunk covers to four fifths."""
    leaves = clauses.where((F.col("is_leaf")) & (F.col("g_end") - F.col("g_start") >= least)).select("document_id", "identifier", "g_start", "g_end")
    best = overlap_join(located(chunks).select(*KEYS, "char_start", "char_end"), leaves).groupBy(*KEYS, "identifier").agg(F.max("overlap_chars").alias("best"))
    asked = chunks.select(*KEYS).distinct().join(leaves, "document_id", "left")
    cut = F.when(F.col("identifier").isNotNull(), (5 * F.coalesce("best", F.lit(0)) < 4 * (F.col("g_end") - F.col("g_start"))).cast("double"))
    return asked.join(best, [*KEYS, "identifier"], "left").groupBy(*KEYS).agg(F.coalesce(F.avg(cut), F.lit(0.0)).alias("clause_fragmentation"))


def over_merge(chunks: DataFrame, clauses: DataFrame, least: int = 50) -> DataFrame:
    """Share of located chunks that reach `least` characters into more than one top-level clause."""
    tops = clauses.where("is_top_level").select("document_id", "identifier", "g_start", F.col("subtree_end").alias("g_end"))
    many = overlap_join(located(chunks).select(*KEYS, "chunk_index", "char_start", "char_end"), tops, least).groupBy(*KEYS, "chunk_index").agg(F.count(F.lit(1)).alias("tops")).groupBy(*KEYS).agg(F.count_if(F.col("tops") > 1).alias("merged"))
    totals = chunks.groupBy(*KEYS).agg(F.count("char_start").alias("n"))
    return totals.join(many, KEYS, "left").select(*KEYS, safe_ratio(F.coalesce("merged", F.lit(0)), F.col("n")).alias("top_level_over_merge"))


def grouping(chunks: DataFrame, clauses: DataFrame) -> DataFrame:
    """Share of located chunks that hold two or more leaves of one parent (to 95 %)."""
    leaves = clauses.where("is_leaf and parent is not null and g_end > g_start").select("document_id", "identifier", "parent", "g_start", "g_end")
    held = overlap_join(located(chunks).select(*KEYS, "chunk_index", "char_start", "char_end"), leaves).where("20 * overlap_chars >= 19 * (g_end - g_start)")
    some = held.groupBy(*KEYS, "chunk_index", "parent").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*KEYS, "chunk_index").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("grouped"))
    totals = chunks.groupBy(*KEYS).agg(F.count("char_start").alias("n"))
    return totals.join(some, KEYS, "left").select(*KEYS, safe_ratio(F.coalesce("grouped", F.lit(0)), F.col("n")).alias("sub_clause_grouping"))


def sizes(chunks: DataFrame) -> DataFrame:
    """Size variation, localisation rate, coverage by span length, counts and means."""
    return chunks.groupBy(*KEYS).agg(
        size_variation(F.col("char_count")).alias("size_cv"),
        F.avg(F.col("char_start").isNotNull().cast("double")).alias("localization_rate"),
        safe_ratio(F.coalesce(F.sum(F.col("char_end") - F.col("char_start")), F.lit(0)), F.sum("char_count")).alias("localization_coverage"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("avg_chunk_size"),
    )


def span_metrics(chunks: DataFrame, clauses: DataFrame) -> DataFrame:
    """Fragmentation, over-merging and grouping as above, from one overlap join: a top-level clause stands with its whole
    subtree there, a leaf with its own span."""
    known = clauses.where("is_leaf or is_top_level").withColumn("own_end", F.col("g_end"))
    known = known.withColumn("g_end", F.when(F.col("is_top_level"), F.greatest("subtree_end", "g_end")).otherwise(F.col("g_end")))
    known = known.select("document_id", "identifier", "parent", "g_start", "g_end", "own_end", "is_leaf", "is_top_level", "subtree_end")
    pairs = overlap_join(located(chunks).select(*KEYS, "chunk_index", "char_start", "char_end"), known)
    own = overlap(F.col("char_start"), F.col("char_end"), F.col("g_start"), F.col("own_end"))
    below = overlap(F.col("char_start"), F.col("char_end"), F.col("g_start"), F.col("subtree_end"))
    size = F.col("own_end") - F.col("g_start")
    pairs = pairs.withColumns({"own": own, "size": size, "reaches": F.col("is_top_level") & (below >= 50)})
    held_ = F.col("is_leaf") & F.col("parent").isNotNull() & (F.col("own") > 0) & (20 * F.col("own") >= 19 * F.col("size"))
    families = pairs.groupBy(*KEYS, "chunk_index", "parent").agg(F.count_if("reaches").alias("tops"), F.count_if(held_).alias("held"))
    each = families.groupBy(*KEYS, "chunk_index").agg(F.sum("tops").alias("tops"), F.max("held").alias("held"))
    of_chunks = each.groupBy(*KEYS).agg(F.count_if(F.col("tops") > 1).alias("merged"), F.count_if(F.col("held") >= 2).alias("grouped"))
    best = pairs.where(F.col("is_leaf") & (F.col("size") >= 20)).groupBy(*KEYS, "identifier", "size").agg(F.max("own").alias("own"))
    whole = best.groupBy(*KEYS).agg(F.count_if(5 * F.col("own") >= 4 * F.col("size")).alias("whole"))
    leaves = clauses.where((F.col("is_leaf")) & (F.col("g_end") - F.col("g_start") >= 20)).groupBy("document_id").agg(F.count(F.lit(1)).alias("leaves"))
    known = clauses.groupBy("document_id").agg(F.count_if("is_leaf").alias("n_leaf_clauses"), F.count_if("is_top_level").alias("n_top_level_clauses"))
    leaves = known.join(leaves, "document_id", "left")
    out = chunks.groupBy(*KEYS).agg(F.count("char_start").alias("n")).join(leaves, "document_id", "left").join(of_chunks, KEYS, "left").join(whole, KEYS, "left")
    out = out.fillna(0, ["leaves", "merged", "grouped", "whole", "n_leaf_clauses", "n_top_level_clauses"])
    share = lambda part, of: safe_ratio(part, F.col(of))
    return out.select(*KEYS, share(F.col("leaves") - F.col("whole"), "leaves").alias("clause_fragmentation"), share(F.col("merged"), "n").alias("top_level_over_merge"), share(F.col("grouped"), "n").alias("sub_clause_grouping"), F.col("n").alias("located_chunks"), "n_leaf_clauses", "n_top_level_clauses")


class StaleError(ValueError):
    """A document is no longer the one that was annotated."""


def unchanged(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """docs whose sanitised text has the length and SHA-256 (n_chars, text_sha256) of its annotation; others raise while
    they are read."""
    clean = sanitized(F.col("text"))
    told = docs.join(annotations.select("document_id", "n_chars", "text_sha256"), "document_id")
    same = (F.length(clean) == F.col("n_chars")) & (F.sha2(clean, 256) == F.col("text_sha256"))
    problem = F.concat(F.lit("StaleError: document "), F.col("document_id").cast("string"), F.lit(" has changed since it was annotated"))
    return told.withColumn("text", F.when(same, F.col("text")).otherwise(F.raise_error(problem))).select(*docs.columns)


#: Metrics of users: name -> function of (chunks, clauses) that gives KEYS and a column of that name.
METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
# Names of the evaluation's own metrics, which others must not take.
TAKEN = frozenset(
    """size_cv localization_rate localization_coverage n_chunks avg_chunk_size clause_fragmentation top_level_over_merge sub_clause_grouping
    located_chunks n_leaf_clauses n_top_level_clauses heading_recall heading_precision n_gold_headings definition_attachment n_definition_uses
    xref_recall xref_precision n_gold_cross_refs""".split()
)


def register_metric(name: str, metric: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A structural metric of one's own, from then on a column of every `structural_row`."""
    if name in TAKEN | set(KEYS) or not name.isidentifier():
        raise ValueError(f"{name} can't be a metric's name")
    METRICS[name] = metric


def structural_row(chunks: DataFrame, clauses: DataFrame, docs: DataFrame | None = None, terms: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """All structural metrics of each strategy and document. Chunks that tell section_hierarchy and cross_references are held
    against clauses and refs; with docs and terms, uses of terms against their definitions."""
    # Spans without texts, used by several branches; what memory can't hold goes to disk.
    told = [c for c in ("section_hierarchy", "cross_references", "definitions", "defined_terms_context") if c in chunks.columns]
    chunks, clauses = held(chunks.select(*KEYS, "chunk_index", "char_start", "char_end", "char_count", *told)), held(clauses)
    parts = [span_metrics(chunks, clauses)]
    if "section_hierarchy" in told:
        parts.append(headings(chunks, clauses))
    if docs is not None and terms is not None:
        parts.append(definition_attachment(chunks, docs, terms))
    if "cross_references" in told and refs is not None:
        parts.append(cross_references(chunks, refs))
    out = sizes(chunks)
    for part in parts:
        out = out.join(part, KEYS)
    for name, metric in METRICS.items():
        out = out.join(metric(chunks, clauses).select(*KEYS, name), KEYS, "left")
    return out


def macro_average(rows: DataFrame, by: list[str], columns: list[str], poison: bool = False) -> DataFrame:
    """Means over documents; with poison a single null makes the mean null, else nulls are skipped."""
    mean = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)) if poison else F.avg(c)
    return rows.groupBy(*by).agg(*[mean(c).alias(c) for c in columns])


def headings(chunks: DataFrame, clauses: DataFrame) -> DataFrame:
    """Recall and precision of the clauses that chunks claim in section_hierarchy; null where no chunk has one, and then all
    clauses are counted.

    A claim counts if its chunk touches a clause at all, and is right if a clause under that key does. Recall is over clauses
    that some chunk reaches 50 characters into.
    """
    from spanlab.functions.identifiers import claimed_identifier, lookup_keys, normalize_identifier

    gold = clauses.select("document_id", "identifier", "g_start", "g_end")
    here = located(chunks).withColumn("claim", claimed_identifier(F.col("section_hierarchy")))
    here = here.select(*KEYS, "chunk_index", "char_start", "char_end", normalize_identifier(F.col("claim")).alias("key"))
    touched = overlap_join(here, gold.withColumn("keys", lookup_keys(F.col("identifier"))))
    named = F.when(F.array_contains("keys", F.col("key")), F.struct("g_start", "identifier"))
    claims = touched.where("key is not null").groupBy(*KEYS, "chunk_index").agg(F.min(named).alias("hit"))
    reached = touched.where("overlap_chars >= 50").select(*KEYS, "identifier").distinct()
    told = claims.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("claims"), F.count("hit").alias("right"))
    found = claims.where("hit is not null").select(*KEYS, "hit.identifier").distinct().join(reached, [*KEYS, "identifier"], "left_semi")
    out = chunks.groupBy(*KEYS).agg(F.bool_or(F.col("section_hierarchy").isNotNull()).alias("_some"))
    for part in (told, found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("found")), reached.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("reached"))):
        out = out.join(part, KEYS, "left")
    out = out.join(gold.groupBy("document_id").agg(F.count(F.lit(1)).alias("all")), "document_id", "left")
    out = out.fillna(0, ["claims", "right", "found", "reached", "all"])
    some = lambda x: F.when(F.col("_some"), x)
    number = F.when(F.col("_some"), F.col("reached")).otherwise(F.col("all")).alias("n_gold_headings")
    return out.select(*KEYS, some(safe_ratio(F.col("found"), F.col("reached"), 1.0)).alias("heading_recall"), some(safe_ratio(F.col("right"), F.col("claims"), 1.0)).alias("heading_precision"), number)


def attached_uses(text: str, terms: list[tuple[str, int, int]], chunks: list[tuple[str, int, int, set[str]]]) -> dict[str, list[int]]:
    """Of one document, by strategy: uses of terms (term, definition_start, definition_end) in chunks (strategy, start, end,
    terms whose definition the chunk carries), and those with the definition at hand.

    All terms are found in one pass over the text. A use is a chunk and a term with a find outside of the definition; what a
    chunk's ends cut off doesn't count, so a word may end where the chunk does.
    """
    phrases = Phrases([term for term, _, _ in terms])
    definitions: dict[str, list[tuple[int, int]]] = {}
    for term, start, end in terms:
        definitions.setdefault(term, []).append((start, end))
    places = sorted((start, start + len(phrases.phrases[n]), n) for start, n in phrases.finds(text))
    starts = [start for start, _, _ in places]
    out: dict[str, list[int]] = {}
    for strategy, start, end, carried in chunks:
        sums = out.setdefault(strategy, [0, 0])
        found: dict[int, list[int]] = {}
        for at, to, n in places[bisect_left(starts, start) : bisect_left(starts, end)]:
            if to <= end and is_whole(text, at, to, start, end):
                found.setdefault(n, []).append(at)
        for n, own in found.items():
            for first, last in definitions[phrases.phrases[n]]:
                if own[0] < first or own[-1] >= last:  # in order, so these tell whether any is outside
                    near = 5 * max(0, min(end, last) - max(start, first)) >= 4 * (last - first) > 0
                    sums[0] += 1
                    sums[1] += near or phrases.phrases[n] in carried
    return out


def definition_attachment(chunks: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Of uses of defined terms outside of their definition, the share whose chunk has the definition (to four fifths, or in
    its map of definitions). Each definition of a term counts for itself.

    A document's chunks and terms, bounded by its text, meet its text in one row; one Arrow pass does the rest.
    """
    maps = [c for c in ("definitions", "defined_terms_context") if c in chunks.columns]
    told = [F.map_keys(F.map_filter(c, lambda _, v: F.length(F.trim(v)) > 0)) for c in maps]
    carried = F.flatten(F.array_compact(F.array(*told))) if told else F.array().cast("array<string>")
    own = located(chunks).groupBy("document_id").agg(F.collect_list(F.struct("strategy", "char_start", "char_end", carried.alias("carried"))).alias("chunks"))
    known = terms.groupBy("document_id").agg(F.collect_list(F.struct("term", "definition_start", "definition_end")).alias("terms"))
    rows = docs.select("document_id", "text").join(own, "document_id").join(known, "document_id")
    kind = docs.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, (text, chunks_, terms_) in enumerate(zip(*(batch.column(c) for c in (1, 2, 3)))):
                listed = [(c["strategy"], c["char_start"], c["char_end"], {*c["carried"]}) for c in chunks_.as_py()]
                for strategy, sums in attached_uses(text.as_py() or "", [tuple(t.values()) for t in terms_.as_py()], listed).items():
                    at.append(k)
                    found.append((strategy, *sums))
            columns = zip(*found) if found else ((), (), ())
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *arrays], ["document_id", "strategy", "uses", "attached"])

    sums = rows.mapInArrow(run, f"document_id {kind}, strategy string, uses bigint, attached bigint")
    out = chunks.select(*KEYS).distinct().join(sums, KEYS, "left").fillna(0, ["uses", "attached"])
    return out.select(*KEYS, safe_ratio(F.col("attached"), F.col("uses"), 1.0).alias("definition_attachment"), F.col("uses").alias("n_definition_uses"))


def cross_references(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Recall and precision of emitted targets (cross_references: array of struct with target) against the references that
    begin in the chunk; null where no chunk has any list."""
    from spanlab.functions.identifiers import normalize_identifier

    inner = refs.where("target is not null").select("document_id", "ref_start", normalize_identifier(F.col("target")).alias("want")).distinct()
    here = located(chunks)
    sent = here.select(*KEYS, "chunk_index", "char_start", "char_end", F.explode("cross_references").alias("r")).where("r.target is not null and r.target <> ''").withColumn("got", normalize_identifier(F.col("r.target")))
    scope = point_in_span(inner, here.select(*KEYS, "chunk_index", "char_start", "char_end")).select(*KEYS, "chunk_index", "ref_start", "want")
    wanted = scope.select(*KEYS, "chunk_index", F.col("want").alias("got")).distinct()
    right = sent.join(wanted, [*KEYS, "chunk_index", "got"], "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("right"))
    recalled = scope.join(sent.select(*KEYS, "chunk_index", F.col("got").alias("want")).distinct(), [*KEYS, "chunk_index", "want"], "left_semi").select(*KEYS, "ref_start", "want").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("recalled"))
    total = inner.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_gold_cross_refs"))
    out = chunks.groupBy(*KEYS).agg(F.bool_or(F.col("cross_references").isNotNull()).alias("_some")).join(total, "document_id", "left")
    for part in (sent.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("sent")), right, recalled):
        out = out.join(part, KEYS, "left")
    out = out.fillna(0, ["sent", "right", "recalled", "n_gold_cross_refs"])
    some = lambda x: F.when(F.col("_some"), x)
    return out.select(*KEYS, some(safe_ratio(F.col("recalled"), F.col("n_gold_cross_refs"), 1.0)).alias("xref_recall"), some(safe_ratio(F.col("right"), F.col("sent"), 1.0)).alias("xref_precision"), "n_gold_cross_refs")
