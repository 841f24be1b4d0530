"""Span joins, unions, structural metrics, sets and filters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions.numbers import poisoned_mean, safe_ratio
from spanlab.operators import chunkers, evidence as E, lexical, spans, structural as S
from spanlab.plans.tables import CLAUSES_SQL, CLIPPED_SQL, FIXED_SQL, RANKING_SQL, TOKENS_SQL, benchmark_queries, clauses, documents, evidence, fixed, full_clauses, number, query, ranking, table, windows
from spanlab.session import held

BOTH_SQL = f"{FIXED_SQL}, {TOKENS_SQL}, {CLAUSES_SQL}, chunks AS (SELECT 'fixed_size' AS strategy, document_id, chunk_index, char_start, char_end FROM fixed UNION ALL SELECT 'token_window', document_id, chunk_index, char_start, char_end FROM windows)"
OVERLAP = "greatest(0, least(char_end, g_end) - greatest(char_start, g_start))"


def both(spark, sf):
    rows = chunkers.chunk(documents(spark, sf), ["fixed_size", "token_window"])
    return rows.select("strategy", "document_id", "chunk_index", "char_start", "char_end", (F.col("char_end") - F.col("char_start")).alias("char_count"))


@query("jn1_overlap_join", f"WITH {FIXED_SQL}, {CLAUSES_SQL} SELECT document_id, chunk_index, identifier, {OVERLAP} AS overlap_chars FROM fixed JOIN clauses USING (document_id) WHERE {OVERLAP} >= 1")
def jn1(spark, sf):
    return spans.overlap_join(fixed(spark, sf).drop("text"), clauses(spark, sf)).select("document_id", "chunk_index", "identifier", F.col("overlap_chars").cast("bigint").alias("overlap_chars"))


@query("jn1_overlap_join_binned", f"WITH {FIXED_SQL}, {CLAUSES_SQL} SELECT document_id, chunk_index, identifier, {OVERLAP} AS overlap_chars FROM fixed JOIN clauses USING (document_id) WHERE {OVERLAP} >= 50")
def jn1_binned(spark, sf):
    return spans.overlap_join(fixed(spark, sf).drop("text"), clauses(spark, sf), 50).select("document_id", "chunk_index", "identifier", F.col("overlap_chars").cast("bigint").alias("overlap_chars"))


@query("jn2_section_match", f"WITH {FIXED_SQL}, {CLAUSES_SQL} SELECT document_id, chunk_index, identifier FROM fixed JOIN clauses USING (document_id) WHERE {OVERLAP} > 0 AND CASE WHEN g_end - g_start < 100 THEN 2 * {OVERLAP} >= g_end - g_start ELSE {OVERLAP} >= 100 END")
def jn2(spark, sf):
    pairs = spans.overlap_join(fixed(spark, sf).drop("text"), clauses(spark, sf))
    return pairs.where(spans.section_match(F.col("overlap_chars"), F.col("g_end") - F.col("g_start"))).select("document_id", "chunk_index", "identifier")


@query("jn3_containment", f"WITH {TOKENS_SQL}, {CLAUSES_SQL} SELECT c.document_id, identifier, coalesce(bool_or(char_start <= g_start AND g_end <= char_end), false) AS contained, count(*) FILTER (WHERE {OVERLAP} > 0) AS touched FROM clauses c LEFT JOIN windows w USING (document_id) GROUP BY ALL")
def jn3(spark, sf):
    gold = clauses(spark, sf).select("document_id", "identifier", "g_start", "g_end")
    return spans.containment(gold, windows(spark, sf).drop("text"), ["document_id"]).select("document_id", "identifier", "contained", "touched")


@query("jn4_selected_evidence", f"WITH {CLIPPED_SQL} SELECT query_id, rank, document_id, greatest(char_start, g_start) AS char_start, least(char_end, g_end) AS char_end FROM clipped JOIN evidence USING (query_id, document_id) WHERE {OVERLAP} > 0")
def jn4(spark, sf):
    cut = lexical.clipped(ranking(spark, sf)).join(evidence(spark, sf), ["query_id", "document_id"])
    rows = cut.select("query_id", F.col("rank").cast("bigint").alias("rank"), "document_id", F.greatest("char_start", "g_start").alias("char_start"), F.least("char_end", "g_end").alias("char_end"))
    return rows.where("char_end > char_start")


@query("jn5_point_in_span", f"WITH {FIXED_SQL}, {CLAUSES_SQL} SELECT document_id, identifier, chunk_index FROM clauses JOIN fixed USING (document_id) WHERE char_start <= g_start AND g_start < char_end")
def jn5(spark, sf):
    points = clauses(spark, sf).select("document_id", "identifier", F.col("g_start").alias("ref_start"))
    return spans.point_in_span(points, fixed(spark, sf).drop("text")).select("document_id", "identifier", "chunk_index")


@query("jn6_token_dot", f"WITH {RANKING_SQL} SELECT query_id, document_id, char_start, round(score, 6) AS score FROM scored WHERE score > 0.35")
def jn6(spark, sf):
    key = ["document_id", "char_start", "char_end"]
    rows = lexical.scored(benchmark_queries(spark, sf), windows(spark, sf), key, 0.35)
    return rows.select("query_id", "document_id", "char_start", number("score").alias("score"))


@query("jn8_clause_lookup", f"WITH {CLAUSES_SQL} SELECT c.document_id, c.identifier, p.g_start, p.subtree_end FROM clauses c JOIN full_clauses p ON p.document_id = c.document_id AND p.identifier = c.parent")
def jn8(spark, sf):
    rows = full_clauses(spark, sf)
    up = rows.select("document_id", F.col("identifier").alias("parent"), F.col("g_start").cast("bigint").alias("g_start"), F.col("subtree_end").cast("bigint").alias("subtree_end"))
    return rows.select("document_id", "identifier", "parent").join(up, ["document_id", "parent"]).drop("parent")


@query("jn14_evidence_ids", "SELECT (item_id // 3)::BIGINT AS query_id, item_id AS evidence_id, doc_id AS document_id, (instr(d.text, b.text) - 1)::BIGINT AS g_start, (instr(d.text, b.text) - 1 + length(b.text))::BIGINT AS g_end FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE item_id % 4 <> 3")
def jn14(spark, sf):
    """Queries that list three items' evidence each, but for every fourth item."""
    ids = benchmark_queries(spark, sf).where("query_id % 4 <> 3").withColumn("group", F.floor(F.col("query_id") / 3))
    asked = ids.groupBy(F.col("group").cast("bigint").alias("query_id")).agg(F.collect_list("query_id").alias("evidence_ids"))
    found = evidence(spark, sf).withColumnRenamed("query_id", "evidence_id")
    return E.resolved(asked, found).select("query_id", "evidence_id", "document_id", "g_start", "g_end")


@query("jn13_label_map", "SELECT source, CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang IN ('fr', 'es') THEN 'romance' END AS target, count(*) AS n FROM documents GROUP BY ALL")
def jn13(spark, sf):
    from spanlab.operators.classification import mapped

    dimension = spark.createDataFrame([("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance")], "source_label string, target string")
    return mapped(documents(spark, sf).withColumnRenamed("lang", "source_label"), dimension).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("jn15_run_comparison", f"WITH {BOTH_SQL}, a AS (SELECT strategy, avg(char_end - char_start) AS m FROM chunks GROUP BY 1), b AS (SELECT strategy, avg(char_end - char_start) AS m FROM chunks WHERE chunk_index > 0 GROUP BY 1) SELECT strategy, round(a.m, 6) AS before_value, round(b.m, 6) AS after_value, round(b.m - a.m, 6) AS delta FROM a JOIN b USING (strategy)")
def jn15(spark, sf):
    rows = both(spark, sf)
    a, b = (x.groupBy("strategy").agg(F.avg("char_count").alias(n)) for x, n in ((rows, "x"), (rows.where("chunk_index > 0"), "y")))
    return a.join(b, "strategy").select("strategy", number("x").alias("before_value"), number("y").alias("after_value"), number(F.col("y") - F.col("x")).alias("delta"))


@query("agg2_interval_union", f"WITH {TOKENS_SQL}, marks AS (SELECT *, CASE WHEN char_start > max(char_end) OVER (PARTITION BY document_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM windows WHERE chunk_index % 3 < 2), islands AS (SELECT *, sum(cut) OVER (PARTITION BY document_id ORDER BY char_start, char_end) AS island FROM marks) SELECT document_id, min(char_start) AS char_start, max(char_end) AS char_end FROM islands GROUP BY document_id, island")
def agg2(spark, sf):
    return spans.merged_intervals(windows(spark, sf).drop("text").where("chunk_index % 3 < 2"), ["document_id"])


EVIDENCE_SQL = CLIPPED_SQL + f""",
 merged AS (SELECT query_id, document_id, g_start, g_end FROM evidence),
 cut AS (SELECT query_id, document_id, greatest(char_start, g_start) AS s, least(char_end, g_end) AS e FROM clipped JOIN merged USING (query_id, document_id) WHERE {OVERLAP} > 0),
 chars AS (SELECT DISTINCT query_id, document_id, unnest(range(s, e)) AS c FROM cut),
 per_query AS (SELECT item_id AS query_id, coalesce((SELECT sum(g_end - g_start) FROM merged m WHERE m.query_id = item_id), 0) AS gold_chars,
                      coalesce((SELECT sum(char_end - char_start) FROM clipped m WHERE m.query_id = item_id), 0) AS selected_chars,
                      (SELECT count(*) FROM clipped m WHERE m.query_id = item_id) AS n_selected, (SELECT count(*) FROM chars m WHERE m.query_id = item_id) AS covered_chars FROM benchmark),
 scores AS (SELECT *, gold_chars > 0 AS answerable, CASE WHEN gold_chars > 0 THEN covered_chars / gold_chars END AS recall,
                   CASE WHEN gold_chars > 0 THEN CASE WHEN selected_chars > 0 THEN covered_chars / selected_chars ELSE 0 END END AS precision FROM per_query)"""


def scored_by(spark, sf, budgets, depth=5):
    """The scores under each budget, of one ranking and one search for evidence: both are a few rows for each query."""
    gold, best = held(evidence(spark, sf)), held(ranking(spark, sf, depth))
    asked = benchmark_queries(spark, sf).select("query_id").join(gold.select("query_id", F.lit(True).alias("answerable")).distinct(), "query_id", "left").fillna(False, ["answerable"])
    return {budget: E.scores(asked, lexical.clipped(best, budget), gold) for budget in budgets}


def scored(spark, sf, budget=128, depth=5):
    return scored_by(spark, sf, [budget], depth)[budget]


@query("agg3_evidence_score", f"WITH {EVIDENCE_SQL} SELECT query_id, answerable, gold_chars::BIGINT AS gold_chars, selected_chars::BIGINT AS selected_chars, covered_chars, round(recall, 6) AS recall, round(precision, 6) AS precision FROM scores")
def agg3(spark, sf):
    return scored(spark, sf).select("query_id", "answerable", "gold_chars", "selected_chars", "covered_chars", number("recall").alias("recall"), number("precision").alias("precision"))


SUMMARY_SQL = "count(*) FILTER (WHERE answerable) AS answerable_n, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, count(*) FILTER (WHERE NOT answerable) AS unanswerable_n, avg(CASE WHEN NOT answerable THEN (n_selected = 0)::INT::DOUBLE END) AS abstention_accuracy"


@query("agg4_evidence_means", f"WITH {EVIDENCE_SQL} SELECT 'token_window' AS strategy, {SUMMARY_SQL} FROM scores")
def agg4(spark, sf):
    out = E.summary(scored(spark, sf).withColumn("strategy", F.lit("token_window")), ["strategy"])
    return out.withColumn("mean_recall", number("mean_recall")).withColumn("mean_precision", number("mean_precision"))


MEANS_SQL = f"WITH {EVIDENCE_SQL} SELECT avg(recall) AS r, avg(precision) AS p FROM scores"


@query("agg5_strategy_deltas", f"""WITH means AS (SELECT 'budget_24' AS strategy, * FROM ({MEANS_SQL.replace("128 -", "24 -")}) UNION ALL SELECT 'budget_400', * FROM ({MEANS_SQL.replace("128 -", "400 -")})),
 d AS (SELECT strategy, m.r - b.r AS dr, m.p - b.p AS dp FROM means m, ({MEANS_SQL}) b)
 SELECT strategy, round(dr, 6) AS recall_delta, round(dp, 6) AS precision_delta, CASE WHEN dr = 0 AND dp = 0 THEN 'tie' WHEN dr >= 0 AND dp >= 0 THEN 'win' WHEN dr <= 0 AND dp <= 0 THEN 'loss' ELSE 'mixed' END AS outcome FROM d""")
def agg5(spark, sf):
    """Smaller and larger token budgets against the usual one."""
    rows = [E.summary(rows.withColumn("strategy", F.lit(f"budget_{budget}")), ["strategy"]) for budget, rows in scored_by(spark, sf, (128, 24, 400)).items()]
    out = E.deltas(rows[0].unionByName(rows[1]).unionByName(rows[2]), "budget_128")
    return out.withColumn("recall_delta", number("recall_delta")).withColumn("precision_delta", number("precision_delta"))


@query("agg24_budget_totals", f"WITH {CLIPPED_SQL} SELECT query_id, sum(tokens)::BIGINT AS tokens, sum(char_end - char_start)::BIGINT AS chars FROM clipped GROUP BY 1")
def agg24(spark, sf):
    return lexical.clipped(ranking(spark, sf)).groupBy("query_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))


@query("win1_lexical_top_k", f"WITH {RANKING_SQL} SELECT query_id, rank, document_id, char_start, round(score, 6) AS score FROM all_ranks WHERE rank <= 5")
def win1(spark, sf):
    return ranking(spark, sf).select("query_id", F.col("rank").cast("bigint").alias("rank"), "document_id", "char_start", number("score").alias("score"))


@query("win3_budget_clip", f"WITH {CLIPPED_SQL} SELECT query_id, rank, document_id, char_start, char_end, tokens FROM clipped")
def win3(spark, sf):
    return lexical.clipped(ranking(spark, sf)).select("query_id", F.col("rank").cast("bigint").alias("rank"), "document_id", "char_start", "char_end", "tokens")


@query("agg1_term_norms", r"SELECT document_id, round(sqrt(sum(n * n)), 6) AS norm, sum(n)::BIGINT AS words FROM (SELECT document_id, token, count(*) AS n FROM (SELECT doc_id AS document_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY ALL) GROUP BY 1")
def agg1(spark, sf):
    counts = lexical.term_counts(documents(spark, sf), ["document_id"])
    return counts.groupBy("document_id").agg(number(F.sqrt(F.sum(F.col("n") * F.col("n")))).alias("norm"), F.sum("n").alias("words"))


FRAGMENT_SQL = f"leaf AS (FROM full_clauses WHERE is_leaf AND g_end - g_start >= 20), frag AS (SELECT strategy, document_id, avg(CASE WHEN 5 * best < 4 * (g_end - g_start) THEN 1.0 ELSE 0.0 END) AS v FROM (SELECT strategy, l.document_id, identifier, g_start, g_end, max({OVERLAP}) AS best FROM leaf l JOIN chunks c USING (document_id) GROUP BY ALL) GROUP BY ALL)"


@query("sm1_fragmentation", f"WITH {BOTH_SQL}, {FRAGMENT_SQL} SELECT strategy, document_id, round(coalesce(v, 0), 6) AS clause_fragmentation FROM (SELECT DISTINCT strategy, document_id FROM chunks) LEFT JOIN frag USING (strategy, document_id)")
def sm1(spark, sf):
    return S.fragmentation(both(spark, sf), full_clauses(spark, sf)).withColumn("clause_fragmentation", number("clause_fragmentation"))


MERGE_SQL = f"tops AS (SELECT document_id, identifier, g_start, subtree_end AS g_end FROM full_clauses WHERE is_top_level), merged AS (SELECT strategy, document_id, count(*) AS merged FROM (SELECT strategy, document_id, chunk_index FROM chunks JOIN tops USING (document_id) WHERE {OVERLAP} >= 50 GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)"


@query("sm2_over_merge", f"WITH {BOTH_SQL}, {MERGE_SQL} SELECT strategy, document_id, round(coalesce(any_value(merged), 0) / count(*), 6) AS top_level_over_merge FROM chunks LEFT JOIN merged USING (strategy, document_id) GROUP BY ALL")
def sm2(spark, sf):
    return S.over_merge(both(spark, sf), full_clauses(spark, sf)).withColumn("top_level_over_merge", number("top_level_over_merge"))


GROUP_SQL = f"held AS (SELECT DISTINCT strategy, document_id, chunk_index FROM (SELECT strategy, document_id, chunk_index, parent FROM chunks JOIN full_clauses USING (document_id) WHERE is_leaf AND parent IS NOT NULL AND g_end > g_start AND {OVERLAP} > 0 AND 20 * {OVERLAP} >= 19 * (g_end - g_start) GROUP BY ALL HAVING count(*) >= 2)), grouped AS (SELECT strategy, document_id, count(*) AS g FROM held GROUP BY ALL)"


@query("sm3_sub_clause_grouping", f"WITH {BOTH_SQL}, {GROUP_SQL} SELECT strategy, document_id, round(coalesce(any_value(g), 0) / count(*), 6) AS sub_clause_grouping FROM chunks LEFT JOIN grouped USING (strategy, document_id) GROUP BY ALL")
def sm3(spark, sf):
    return S.grouping(both(spark, sf), full_clauses(spark, sf)).withColumn("sub_clause_grouping", number("sub_clause_grouping"))


#: Chunks of a document's every seventh index aren't located.
LOST = "chunk_index % 7 = 5"
SIZES = "strategy, document_id, CASE WHEN count(*) < 2 THEN 0 ELSE round(stddev_pop(char_end - char_start) / avg(char_end - char_start), 6) END AS size_cv, count(*) AS n_chunks, round(avg(char_end - char_start), 6) AS avg_chunk_size"


@query("sm7_sm8_sizes", f"WITH {BOTH_SQL} SELECT {SIZES}, round(avg((NOT {LOST})::INT), 6) AS localization_rate, round(coalesce(sum(char_end - char_start) FILTER (WHERE NOT {LOST}), 0) / sum(char_end - char_start), 6) AS localization_coverage FROM chunks GROUP BY ALL")
def sm78(spark, sf):
    rows = both(spark, sf)
    rows = rows.withColumns({c: F.when(~F.expr(LOST), F.col(c)) for c in ("char_start", "char_end")})
    numbers = ["size_cv", "avg_chunk_size", "localization_rate", "localization_coverage"]
    return S.sizes(rows).withColumns({c: number(c) for c in numbers})


MACRO = ["clause_fragmentation", "top_level_over_merge", "sub_clause_grouping", "size_cv"]
ROW_SQL = f"WITH {BOTH_SQL}, {FRAGMENT_SQL}, {MERGE_SQL}, {GROUP_SQL}, sized AS (SELECT {SIZES} FROM chunks GROUP BY ALL), structural AS (SELECT s.*, coalesce(v, 0) AS clause_fragmentation, coalesce(merged, 0) / n_chunks AS top_level_over_merge, coalesce(g, 0) / n_chunks AS sub_clause_grouping FROM sized s LEFT JOIN frag USING (strategy, document_id) LEFT JOIN merged USING (strategy, document_id) LEFT JOIN grouped USING (strategy, document_id))"


@query("sm9_structural_row", f"{ROW_SQL} SELECT strategy, document_id, size_cv, n_chunks, round(clause_fragmentation, 6) AS clause_fragmentation, round(top_level_over_merge, 6) AS top_level_over_merge, round(sub_clause_grouping, 6) AS sub_clause_grouping FROM structural")
def sm9(spark, sf):
    rows = S.structural_row(both(spark, sf), full_clauses(spark, sf))
    return rows.select("strategy", "document_id", "n_chunks", *[number(c).alias(c) for c in MACRO])


@query("agg6_macro_poisoned", f"WITH {BOTH_SQL}, x AS (SELECT strategy, document_id, CASE WHEN chunk_index % 9 < 8 THEN (char_end - char_start)::DOUBLE END AS v FROM chunks) SELECT strategy, document_id, coalesce(round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6), -1) AS poisoned, round(avg(v), 6) AS skipping FROM x GROUP BY ALL")
def agg6(spark, sf):
    """Documents of nine chunks or more hold a null (-1 here), the others none."""
    rows = both(spark, sf).withColumn("x", F.when(F.col("chunk_index") % 9 < 8, F.col("char_count").cast("double")))
    return rows.groupBy("strategy", "document_id").agg(F.coalesce(number(poisoned_mean(F.col("x"))), F.lit(-1.0)).alias("poisoned"), number(F.avg("x")).alias("skipping"))


@query("agg7_macro_average", f"{ROW_SQL} SELECT strategy, round(avg(clause_fragmentation), 5) AS clause_fragmentation, round(avg(top_level_over_merge), 5) AS top_level_over_merge, round(avg(sub_clause_grouping), 5) AS sub_clause_grouping, round(avg(size_cv), 5) AS size_cv FROM structural GROUP BY 1")
def agg7(spark, sf):
    rows = S.macro_average(S.structural_row(both(spark, sf), full_clauses(spark, sf)), ["strategy"], MACRO)
    return rows.select("strategy", *[number(c, 5).alias(c) for c in MACRO])


@query("agg19_composite_pivot", f"{ROW_SQL}, doc AS (SELECT doc_id AS document_id, lang FROM documents), composite AS (SELECT strategy, lang, avg((1 + 1 - clause_fragmentation + 1 - top_level_over_merge + sub_clause_grouping) / 4) AS c FROM structural JOIN doc USING (document_id) GROUP BY ALL) SELECT strategy, round(coalesce(max(c) FILTER (WHERE lang = 'de'), 0), 3) AS de, round(coalesce(max(c) FILTER (WHERE lang = 'en'), 0), 3) AS en, round(coalesce(max(c) FILTER (WHERE lang = 'es'), 0), 3) AS es, round(coalesce(max(c) FILTER (WHERE lang = 'fr'), 0), 3) AS fr FROM composite GROUP BY 1")
def agg19(spark, sf):
    rows = S.structural_row(both(spark, sf), full_clauses(spark, sf)).join(documents(spark, sf).select("document_id", "lang"), "document_id")
    score = (F.col("localization_rate") + 1 - F.col("clause_fragmentation") + 1 - F.col("top_level_over_merge") + F.col("sub_clause_grouping")) / 4
    return rows.groupBy("strategy").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg(score), 3)).fillna(0.0)


@query("agg20_best_worst", f"WITH {BOTH_SQL}, m AS (SELECT strategy, avg(char_end - char_start) AS v FROM chunks GROUP BY 1) SELECT strategy, v = max(v) OVER () AS best, v = min(v) OVER () AS worst FROM m")
def agg20(spark, sf):
    from spanlab.operators.report import best_worst

    return best_worst(both(spark, sf).groupBy("strategy").agg(F.avg("char_count").alias("v")), "v", True).select("strategy", "best", "worst")


@query("agg12_overlap_histogram", f"WITH {TOKENS_SQL}, {CLAUSES_SQL}, t AS (SELECT c.document_id, identifier, count(*) FILTER (WHERE {OVERLAP} > 0) AS n FROM clauses c LEFT JOIN windows w USING (document_id) GROUP BY ALL) SELECT least(n, 4)::BIGINT AS bucket, count(*) AS n FROM t GROUP BY 1")
def agg12(spark, sf):
    from spanlab.operators.containment import touched_histogram

    gold = clauses(spark, sf).select("document_id", "identifier", "g_start", "g_end")
    return touched_histogram(spans.containment(gold, windows(spark, sf).drop("text"), ["document_id"]))


@query("agg22_containment_lift", f"WITH {TOKENS_SQL}, {CLAUSES_SQL}, t AS (SELECT c.document_id, identifier, g_end - g_start AS len, coalesce(bool_or(char_start <= g_start AND g_end <= char_end), false) AS inside FROM clauses c LEFT JOIN windows w USING (document_id) GROUP BY ALL), l AS (SELECT avg(char_end - char_start) AS m FROM windows) SELECT round(avg(inside::INT), 6) AS containment, round(avg(greatest(0, 1 - len / m)), 6) AS expected, round(avg(inside::INT) - avg(greatest(0, 1 - len / m)), 6) AS lift FROM t, l")
def agg22(spark, sf):
    from spanlab.operators.containment import lift

    gold = clauses(spark, sf).select("document_id", "identifier", "g_start", "g_end")
    chunks = windows(spark, sf).drop("text")
    return lift(spans.containment(gold, chunks, ["document_id"]), chunks).select(*[number(c).alias(c) for c in ("containment", "expected", "lift")])


@query("agg21_structure_recall", f"WITH {CLAUSES_SQL}, t AS (SELECT document_id, count(*) FILTER (WHERE is_top_level) AS tops, count(*) AS nodes FROM clauses GROUP BY 1) SELECT count(*) FILTER (WHERE tops >= 3) AS enough_top, count(*) FILTER (WHERE nodes >= 3) AS enough_any, count(*) FILTER (WHERE nodes = 1) AS single, round(avg(nodes), 6) AS mean_nodes, median(nodes)::DOUBLE AS median_nodes FROM t")
def agg21(spark, sf):
    from spanlab.operators.containment import structure_recall

    return structure_recall(clauses(spark, sf), 3).withColumn("mean_nodes", number("mean_nodes"))


@query("agg11_medians", f"WITH {TOKENS_SQL} SELECT document_id, median(char_end - char_start)::DOUBLE AS median_size, round(avg(char_end - char_start), 6) AS mean_size FROM windows GROUP BY 1")
def agg11(spark, sf):
    return windows(spark, sf).withColumn("n", F.col("char_end") - F.col("char_start")).groupBy("document_id").agg(F.median("n").alias("median_size"), number(F.avg("n")).alias("mean_size"))


@query("agg18_class_distribution", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def agg18(spark, sf):
    docs = documents(spark, sf)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("lang", "n", number(F.col("n") / F.col("total")).alias("share"))


@query("flt8_clause_filters", f"WITH {CLAUSES_SQL} SELECT document_id, identifier FROM clauses WHERE is_top_level AND contains(lower(heading), 'license')")
def flt8(spark, sf):
    return clauses(spark, sf).where(F.col("is_top_level") & F.contains(F.lower("heading"), F.lit("license"))).select("document_id", "identifier")


@query("set1_common_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set1(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("set2_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set2(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("set3_union", f"WITH {BOTH_SQL} SELECT document_id, count(*) AS n FROM chunks GROUP BY 1")
def set3(spark, sf):
    return both(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("set4_intersection_counts", f"WITH {FIXED_SQL}, {CLAUSES_SQL}, a AS (SELECT DISTINCT document_id, identifier FROM clauses JOIN fixed USING (document_id) WHERE {OVERLAP} >= 50), b AS (SELECT document_id, identifier FROM full_clauses WHERE is_leaf) SELECT document_id, count(*) AS n FROM (FROM a INTERSECT FROM b) GROUP BY 1")
def set4(spark, sf):
    a = spans.overlap_join(fixed(spark, sf).drop("text"), clauses(spark, sf), 50).select("document_id", "identifier").distinct()
    return a.intersect(spans.leaves(clauses(spark, sf)).select("document_id", "identifier")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("set6_dedup_spans", "SELECT DISTINCT source, lang, length(text)::BIGINT AS n FROM documents")
def set6(spark, sf):
    return documents(spark, sf).select("source", "lang", F.length("text").cast("bigint").alias("n")).dropDuplicates()


@query("set8_word_overlap", r"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS l FROM documents) SELECT a.doc_id AS document_id, round(len(list_intersect(a.l, b.l)) / len(a.l), 6) AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 WHERE len(a.l) > 0")
def set8(spark, sf):
    w = documents(spark, sf).select("document_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("l"))
    after = w.select((F.col("document_id") - 1).alias("document_id"), F.col("l").alias("m"))
    return w.join(after, "document_id").where("size(l) > 0").select("document_id", number(safe_ratio(F.size(F.array_intersect("l", "m")), F.size("l"))).alias("overlap"))


@query("src7_span_contracts", "SELECT doc_id AS document_id, count(DISTINCT item_id) AS n_spans, min(instr(d.text, b.text) - 1)::BIGINT AS first_start FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def src7(spark, sf):
    from spanlab.sources.datasets import span_contracts

    found = evidence(spark, sf).join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer")), "query_id")
    rows = found.join(documents(spark, sf).select("document_id", F.col("text").alias("context")), "document_id")
    rows = rows.select(F.col("document_id").alias("title"), "context", F.col("query_id").cast("string").alias("question"), F.struct(F.array(F.col("g_start").cast("int")).alias("answer_start"), F.array("answer").alias("text")).alias("answers"))
    return span_contracts(rows).select(F.col("contract_id").alias("document_id"), F.size("spans").cast("bigint").alias("n_spans"), F.col("spans")[0]["start"].cast("bigint").alias("first_start"))
