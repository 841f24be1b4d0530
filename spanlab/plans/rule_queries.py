"""Filters, projections, validators and report views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import chunkers, lexical, locate, report, spans, validate
from spanlab.plans.retrieval_queries import HITS_SQL, hits, sections
from spanlab.plans.span_queries import BOTH_SQL, both
from spanlab.plans.tables import CLAUSES_SQL, CLIPPED_SQL, TOKENS_SQL, clauses, documents, benchmark_queries, full_clauses, query, ranking, windows


@query("flt1_located_chunks", f"WITH {TOKENS_SQL} SELECT document_id, count(*) AS n FROM windows WHERE chunk_index % 2 = 0 GROUP BY 1")
def flt1(spark, sf):
    from spanlab.operators.structural import located

    rows = windows(spark, sf).withColumn("char_start", F.when(F.col("chunk_index") % 2 == 0, F.col("char_start")))
    return located(rows).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt3_eligible_leaves", f"WITH {CLAUSES_SQL} SELECT document_id, identifier FROM full_clauses WHERE is_leaf AND g_end - g_start >= 20")
def flt3(spark, sf):
    return spans.leaves(clauses(spark, sf)).where("g_end - g_start >= 20").select("document_id", "identifier")


@query("flt6_valid_ranks", f"WITH {HITS_SQL} SELECT query_id, count(*) AS n, max(rank) AS deepest FROM hits WHERE rank BETWEEN 1 AND 5 GROUP BY 1")
def flt6(spark, sf):
    rows = hits(spark, sf).where(F.col("rank").between(1, 5))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").cast("bigint").alias("deepest"))


@query("flt9_positive_overlap", f"WITH {HITS_SQL} SELECT query_id, count(*) AS candidates FROM scored GROUP BY 1")
def flt9(spark, sf):
    return lexical.sharing(benchmark_queries(spark, sf), windows(spark, sf), ["document_id", "char_start", "char_end"])


@query("flt11_documents_with_evidence", "SELECT doc_id AS document_id FROM documents d WHERE EXISTS (FROM benchmark b WHERE contains(d.text, b.text))")
def flt11(spark, sf):
    from spanlab.plans.tables import evidence

    return documents(spark, sf).select("document_id").join(evidence(spark, sf).select("document_id"), "document_id", "left_semi")


@query("win5_win6_ranks", f"WITH {HITS_SQL} SELECT query_id, max(rank) FILTER (WHERE rank <= 3) AS deepest, coalesce((SELECT min(rank) FROM matched m WHERE m.query_id = h.query_id), 0) AS first FROM hits h GROUP BY 1")
def win56(spark, sf):
    from spanlab.operators.retrieval import matches, usable_sections

    rows = hits(spark, sf)
    first = matches(rows, usable_sections(sections(spark, sf))).groupBy("query_id").agg(F.min("rank").cast("bigint").alias("first"))
    deepest = rows.groupBy("query_id").agg(F.max(F.when(F.col("rank") <= 3, F.col("rank"))).cast("bigint").alias("deepest"))
    return deepest.join(first, "query_id", "left").fillna(0, ["first"])


@query("txt11_context_header", "SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '[Section: ' || source || CASE WHEN doc_id % 3 = 1 THEN ' | Terms: a, b' ELSE ' | Refs: z, y, x' END || ']' || chr(10) END AS header FROM documents")
def txt11(spark, sf):
    part = F.col("document_id") % 3
    none = F.array().cast("array<string>")
    terms, refs = F.when(part == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(none), F.when(part == 2, F.array(*map(F.lit, "zyxw"))).otherwise(none)
    return documents(spark, sf).select("document_id", T.context_header(F.when(part > 0, F.col("source")), F.lit(None).cast("string"), terms, refs).alias("header"))


RULES_SQL = f"""WITH {CLAUSES_SQL},
 c AS (SELECT *, k % 3 AS r, document_id::VARCHAR AS d FROM clauses),
 kinds AS (SELECT document_id, d, k, r, identifier, parent, g_start, g_end, n_chars,
                  CASE WHEN k = 0 THEN 'none' WHEN k % 11 = 3 AND r = 0 THEN 'flag' WHEN k % 11 = 4 AND r > 0 THEN 'unknown' WHEN k % 11 = 5 AND r > 0 THEN 'level' WHEN k % 11 = 7 AND r > 0 THEN 'orphan' ELSE 'none' END AS kind
           FROM c JOIN (SELECT doc_id AS document_id, length(text) AS n_chars FROM documents) USING (document_id))
 SELECT d AS document_id, 'bounds of ' || identifier AS what FROM kinds WHERE g_end <= g_start
 UNION ALL SELECT d, 'top-level flag of ' || identifier FROM kinds WHERE kind IN ('flag')
 UNION ALL SELECT d, 'unknown parent of ' || identifier FROM kinds WHERE kind = 'unknown'
 UNION ALL SELECT d, 'parent level or place of ' || identifier FROM kinds WHERE kind = 'level'
 UNION ALL SELECT d, 'no parent of ' || identifier FROM kinds WHERE kind = 'orphan'"""


@query("val1_clause_rules", RULES_SQL.replace("n_chars\n           FROM c JOIN", "x.n_chars\n           FROM c JOIN").replace("length(text) AS n_chars FROM documents) USING", "length(text) AS n_chars FROM documents) x USING"))
def val1(spark, sf):
    """Clauses with one rule broken here and there."""
    rows = full_clauses(spark, sf).join(documents(spark, sf).select("document_id", F.length("text").alias("n_chars")), "document_id")
    k = F.substring("identifier", 2, 9).cast("int")
    spot = lambda n, child: (k > 0) & (k % 11 == n) & ((k % 3 > 0) if child else (k % 3 == 0))
    rows = rows.withColumn("level", F.when(spot(5, True), 3).when(F.col("is_top_level"), 1).otherwise(2))
    rows = rows.withColumn("parent", F.when(spot(4, True), "gone").when(spot(7, True), None).otherwise(F.col("parent")))
    rows = rows.withColumn("is_top_level", F.when(spot(3, False), False).otherwise(F.col("is_top_level")))
    return validate.clause_violations(rows)


@query("val5_text_digests", "SELECT doc_id::VARCHAR AS document_id, 'another text' AS what FROM documents WHERE doc_id % 10 = 0")
def val5(spark, sf):
    rows = documents(spark, sf)
    gold = rows.select("document_id", F.length("text").alias("n_chars"), F.sha2(F.encode(F.when(F.col("document_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "UTF-8"), 256).alias("text_sha256"))
    return validate.document_violations(gold, rows)


@query("val7_selected_spans", f"WITH {CLIPPED_SQL} SELECT document_id::VARCHAR AS document_id, 'selected span' AS what FROM clipped WHERE rank = 1")
def val7(spark, sf):
    from spanlab.operators.lexical import clipped

    rows = clipped(ranking(spark, sf))
    return validate.selection_violations(rows.withColumn("char_end", F.when(F.col("rank") == 1, F.col("char_start")).otherwise(F.col("char_end"))))


@query("report_size_histogram", f"WITH {BOTH_SQL}, b AS (SELECT strategy, char_end - char_start AS n, min(char_end - char_start) OVER (PARTITION BY strategy) AS lo, max(char_end - char_start) OVER (PARTITION BY strategy) AS hi FROM chunks) SELECT strategy, CASE WHEN hi > lo THEN least(floor((n - lo) * 20 / (hi - lo)), 19) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM b GROUP BY 1, 2")
def histogram(spark, sf):
    return report.size_histogram(both(spark, sf)).withColumn("bin", F.col("bin").cast("bigint"))


@query("chk10_all_strategies")
def chk10(spark, sf):
    rows = chunkers.chunk(documents(spark, sf))
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"))
