"""Row-level rules. Each gives its violations as rows (document_id, what); `raise_if_any` makes an error of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.operators.spans import merged_intervals

SHOWN = 20


def _told(rows: DataFrame, rule: Column, what: Column) -> DataFrame:
    return rows.where(rule).select(F.col("document_id").cast("string").alias("document_id"), what.alias("what"))


def raise_if_any(found: DataFrame, error: type[Exception] = ValueError) -> None:
    rows = found.orderBy("document_id", "what").limit(SHOWN).collect()
    if rows:
        raise error("; ".join(f"{r.document_id}: {r.what}" for r in rows))


def clause_violations(clauses: DataFrame) -> DataFrame:
    """Bounds, order without overlap, unique identifiers, levels one below an earlier parent, and the top-level flag."""
    order = Window.partitionBy("document_id").orderBy("g_start", "g_end")
    rows = clauses.withColumn("_before", F.lag("g_end").over(order)).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("document_id", "identifier")))
    name = F.col("identifier")
    out = _told(rows, (F.col("g_start") < 0) | (F.col("g_end") <= F.col("g_start")) | (F.col("g_end") > F.col("n_chars")), F.concat(F.lit("bounds of "), name))
    out = out.unionByName(_told(rows, F.col("g_start") < F.col("_before"), F.concat(F.lit("overlap before "), name)))
    out = out.unionByName(_told(rows, F.col("_same") > 1, F.concat(F.lit("repeated "), name)).distinct())
    out = out.unionByName(_told(rows, F.col("is_top_level") != (F.col("level") == 1), F.concat(F.lit("top-level flag of "), name)))
    up = clauses.select("document_id", F.col("identifier").alias("parent"), F.col("level").alias("_level"), F.col("g_start").alias("_start"))
    held = rows.where("parent is not null").join(up, ["document_id", "parent"], "left")
    out = out.unionByName(_told(held, F.col("_level").isNull(), F.concat(F.lit("unknown parent of "), name)))
    out = out.unionByName(_told(held, (F.col("_level") != F.col("level") - 1) | (F.col("_start") >= F.col("g_start")), F.concat(F.lit("parent level or place of "), name)))
    return out.unionByName(_told(rows, (F.col("level") > 1) & F.col("parent").isNull(), F.concat(F.lit("no parent of "), name)))


def term_violations(terms: DataFrame) -> DataFrame:
    rule = (F.col("definition_start") < 0) | (F.col("definition_end") <= F.col("definition_start")) | (F.col("definition_end") > F.col("n_chars"))
    return _told(terms, F.coalesce(rule, F.lit(True)), F.concat(F.lit("bounds of term "), F.coalesce("term", F.lit("?"))))


def reference_violations(refs: DataFrame, clauses: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    name = F.concat("raw_text", F.lit(" at "), F.col("ref_start").cast("string"))
    out = _told(refs, ~F.col("kind").isin(*kinds), F.concat(F.lit("kind of "), name))
    out = out.unionByName(_told(refs, (F.col("ref_start") < 0) | (F.col("ref_end") > F.col("n_chars")), F.concat(F.lit("bounds of "), name)))
    inner = refs.where(F.startswith("kind", F.lit("internal_")))
    lost = inner.join(clauses.select("document_id", F.col("identifier").alias("target")), ["document_id", "target"], "left_anti")
    return out.unionByName(_told(lost, F.lit(True), F.concat(F.lit("unresolved "), name)))


def document_violations(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Length and SHA-256 of the text that was annotated."""
    both = gold.select("document_id", "n_chars", "text_sha256").join(docs.select("document_id", "text"), "document_id", "left")
    rule = F.col("text").isNull() | (F.length("text") != F.col("n_chars")) | (F.sha2(F.encode("text", "UTF-8"), 256) != F.col("text_sha256"))
    return _told(both, rule, F.lit("another text"))


def evidence_violations(docs: DataFrame, evidence: DataFrame, queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Slices equal texts, grades are 1 to 3, answerable queries have evidence, answers lie in the union of theirs."""
    texts = docs.select("document_id", F.col("text").alias("_text"))
    slice_ = lambda a, b: F.expr(f"substring(_text, {a} + 1, {b} - {a})")
    e = evidence.join(texts, "document_id", "left")
    out = _told(e, F.coalesce((F.col("g_start") < 0) | (F.col("g_end") <= F.col("g_start")) | (slice_("g_start", "g_end") != F.col("text")), F.lit(True)), F.concat(F.lit("slice of "), "evidence_id"))
    out = out.unionByName(_told(e, ~F.col("grade").between(1, 3), F.concat(F.lit("grade of "), "evidence_id")))
    a = answers.join(texts, "document_id", "left")
    out = out.unionByName(_told(a, F.coalesce(slice_("char_start", "char_end") != F.col("text"), F.lit(True)), F.concat(F.lit("answer of "), "query_id")))
    asked = queries.withColumn("document_id", F.col("query_id"))
    out = out.unionByName(_told(asked, F.col("answerable") != (F.size("evidence_ids") > 0), F.concat(F.lit("answerability of "), "query_id")))
    ids = queries.select("query_id", F.explode("evidence_ids").alias("evidence_id"))
    lost = ids.join(evidence, "evidence_id", "left_anti").withColumn("document_id", F.col("query_id"))
    out = out.unionByName(_told(lost, F.lit(True), F.concat(F.lit("unknown evidence "), "evidence_id")))
    union = merged_intervals(ids.join(evidence, "evidence_id"), ["query_id", "document_id"], "g_start", "g_end").select("query_id", "document_id", "g_start", "g_end")
    bare = answers.join(union, ["query_id", "document_id"], "left").groupBy("query_id", "document_id", "char_start", "char_end").agg(F.coalesce(F.bool_or((F.col("g_start") <= F.col("char_start")) & (F.col("char_end") <= F.col("g_end"))), F.lit(False)).alias("_in"))
    return out.unionByName(_told(bare, ~F.col("_in"), F.concat(F.lit("answer outside of evidence: "), "query_id")))


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """Unique ids; spans as long as their text."""
    twice = candidates.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("document_id").alias("document_id")).where("n > 1")
    out = _told(twice, F.lit(True), F.concat(F.lit("repeated candidate "), F.col("id").cast("string")))
    return out.unionByName(_told(candidates, F.col("char_end") - F.col("char_start") != F.length("text"), F.concat(F.lit("span of "), F.col("id").cast("string"))))


def selection_violations(selected: DataFrame) -> DataFrame:
    return _told(selected, F.coalesce((F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")), F.lit(True)), F.lit("selected span"))


def query_set_violations(sections: DataFrame, docs: DataFrame, clauses: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Each query has an exact section, points to a quarter of the characters and three tenths of the clauses at most, is of a
    known category, and doesn't name a clause it looks for."""
    size = docs.select("document_id", F.length("text").alias("n_chars"))
    union = merged_intervals(sections.where("grade > 0"), ["query_id", "document_id"], "g_start", "g_end").groupBy("query_id", "document_id").agg(F.sum(F.col("g_end") - F.col("g_start")).alias("chars")).join(size, "document_id")
    out = _told(union, 4 * F.col("chars") > F.col("n_chars"), F.concat(F.lit("too many characters: "), "query_id"))
    many = sections.where("grade > 0").groupBy("query_id", "document_id").agg(F.countDistinct("section_id").alias("n"), F.bool_or(F.col("grade") == 3).alias("exact")).join(clauses.groupBy("document_id").agg(F.count(F.lit(1)).alias("all")), "document_id")
    out = out.unionByName(_told(many, 10 * F.col("n") > 3 * F.col("all"), F.concat(F.lit("too many clauses: "), "query_id"))).unionByName(_told(many, ~F.col("exact"), F.concat(F.lit("no exact section: "), "query_id")))
    out = out.unionByName(_told(sections, ~F.coalesce(F.col("category").isin(*categories), F.lit(False)), F.concat(F.lit("category of "), "query_id")).distinct())
    leak = F.contains(F.lower("text"), F.lower(F.regexp_replace("section_id", "_", " ")))
    return out.unionByName(_told(sections, leak & F.col("section_id").rlike("[a-z]"), F.concat(F.lit("names its clause: "), "query_id")).distinct())


def vector_violations(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where((F.col("vec").isNull()) | (F.size("vec") != dim)).select(F.col("vec_id").cast("string").alias("document_id"), F.lit("vector length").alias("what"))
