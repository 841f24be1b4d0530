"""Chunkers, text functions and structure over the driver's documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.functions.numbers import size_variation
from spanlab.operators import chunkers, locate, spans
from spanlab.sources import table_functions
from spanlab.plans.tables import CLAUSES_SQL, FIXED_SQL, TOKENS_SQL, clauses, documents, fixed, full_clauses, lines, number, query, table, windows

SPAN_COLUMNS = ["document_id", "chunk_index", "char_start", "char_end"]


@query("chk1_fixed_size", f"WITH {FIXED_SQL} SELECT document_id, chunk_index, char_start, char_end, md5(text) AS digest FROM fixed")
def chk1(spark, sf):
    return fixed(spark, sf).select(*SPAN_COLUMNS, F.md5("text").alias("digest"))


@query("chk2_token_window", f"WITH {TOKENS_SQL} SELECT document_id, chunk_index, char_start, char_end, md5(text) AS digest FROM window_texts")
def chk2(spark, sf):
    return windows(spark, sf).select(*SPAN_COLUMNS, F.md5("text").alias("digest"))


SENTENCE_SQL = r"""
 WITH RECURSIVE cut AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n', chr(1), 'g'), chr(1)),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
 parts AS (SELECT document_id, unnest(l) AS s, generate_subscripts(l, 1) AS i, len(l) AS n FROM cut),
 fold AS (SELECT document_id, i, n, s AS held, 0 AS k, NULL::VARCHAR AS done FROM parts WHERE i = 1
          UNION ALL
          SELECT p.document_id, p.i, p.n, CASE WHEN length(f.held) >= 100 THEN p.s ELSE f.held || ' ' || p.s END,
                 f.k + (length(f.held) >= 100)::INT, CASE WHEN length(f.held) >= 100 THEN f.held END
          FROM fold f JOIN parts p ON p.document_id = f.document_id AND p.i = f.i + 1),
 chunks AS (SELECT document_id, k - 1 AS chunk_index, done AS text FROM fold WHERE done IS NOT NULL UNION ALL SELECT document_id, k, held FROM fold WHERE i = n)"""


@query("chk3_sentence_split", SENTENCE_SQL + " SELECT document_id, chunk_index::BIGINT AS chunk_index, length(text)::BIGINT AS char_count, md5(text) AS digest FROM chunks")
def chk3(spark, sf):
    return chunkers.sentence_split(documents(spark, sf)).select("document_id", "chunk_index", F.length("text").cast("bigint").alias("char_count"), F.md5("text").alias("digest"))


SENTENCES_SQL = r"""
 cut AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?[.!?]\s+|(?s).+$') AS l FROM documents),
 sentence AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM cut),
 placed AS (SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS s FROM sentence),
 filled AS (SELECT doc_id, s, s + length(regexp_replace(p, '\s+$', '')) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS n
            FROM placed WHERE regexp_matches(p, '\S')),
 sentence_windows AS (SELECT doc_id AS document_id, w.w AS chunk_index, min(s)::BIGINT AS char_start, max(e)::BIGINT AS char_end
                      FROM filled f, LATERAL (SELECT j // 2 AS w UNION ALL SELECT j // 2 - 1) w
                      WHERE w.w >= 0 AND j < w.w * 2 + 3 AND (w.w = 0 OR w.w * 2 + 1 < n) GROUP BY 1, 2)"""


@query("chk4_sentence_window", f"WITH {SENTENCES_SQL} SELECT * FROM sentence_windows")
def chk4(spark, sf):
    return chunkers.sentence_window(documents(spark, sf)).select(*SPAN_COLUMNS)


@query("chk5_recursive_character")
def chk5(spark, sf):
    return chunkers.recursive_character(documents(spark, sf)).select(*SPAN_COLUMNS)


@query("chk6_clause_aware")
def chk6(spark, sf):
    return chunkers.clause_aware(documents(spark, sf)).select(*SPAN_COLUMNS)


@query("chk7_contextual", f"WITH {CLAUSES_SQL} SELECT document_id, identifier, '[Section: ' || identifier || ' | Type: ' || CASE WHEN is_top_level THEN 'top' ELSE 'item' END || CASE WHEN parent IS NOT NULL THEN ' | Refs: ' || parent ELSE '' END || ']' || chr(10) || heading AS text, heading AS original_text FROM clauses")
def chk7(spark, sf):
    rows = clauses(spark, sf).withColumn("section_hierarchy", F.col("identifier")).withColumn("clause_type", F.when(F.col("is_top_level"), "top").otherwise("item"))
    rows = rows.withColumn("defined_terms", F.array().cast("array<string>")).withColumn("cross_references", F.array_compact(F.array("parent"))).withColumn("text", F.col("heading"))
    return chunkers.contextual(rows).select("document_id", "identifier", "text", "original_text")


@query("chk8_boundary_candidates", f"WITH {CLAUSES_SQL} SELECT document_id, identifier, g_start, g_end, md5(substring(text, (g_start + 1)::INT, (g_end - g_start)::INT)) AS digest FROM clauses JOIN documents ON doc_id = document_id WHERE g_end > g_start AND g_end <= length(text)")
def chk8(spark, sf):
    rows = clauses(spark, sf).join(documents(spark, sf), "document_id").where((F.col("g_end") > F.col("g_start")) & (F.col("g_end") <= F.length("text")))
    return rows.select("document_id", "identifier", F.col("g_start").cast("bigint").alias("g_start"), F.col("g_end").cast("bigint").alias("g_end"), F.md5(T.substring(F.col("text"), F.col("g_start"), F.col("g_end"))).alias("digest"))


@query("chk9_chunk_set_summary", f"WITH {FIXED_SQL} SELECT document_id, count(*) AS n_chunks, round(coalesce(avg(char_end - char_start), 0), 6) AS avg_chunk_size FROM fixed GROUP BY 1")
def chk9(spark, sf):
    return fixed(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), number(F.coalesce(F.avg(F.col("char_end") - F.col("char_start")), F.lit(0.0))).alias("avg_chunk_size"))


PARAMETERS = {"fixed_size": '{"size": 512}', "token_window": '{"overlap": 8, "window": 64}'}


@query("chk11_strategy_parameters", f"WITH {FIXED_SQL}, {TOKENS_SQL} SELECT 'fixed_size' AS strategy, '{PARAMETERS['fixed_size']}' AS parameters, count(*) AS n_chunks, sum(char_end - char_start)::BIGINT AS chars FROM fixed UNION ALL SELECT 'token_window', '{PARAMETERS['token_window']}', count(*), sum(char_end - char_start)::BIGINT FROM windows")
def chk11(spark, sf):
    """The parameters of strategies as used, beside what they made of all documents."""
    made = chunkers.chunk(documents(spark, sf), ["fixed_size", "token_window"]).groupBy("strategy")
    made = made.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    return chunkers.strategy_parameters(spark).join(made, "strategy").select("strategy", "parameters", "n_chunks", "chars")


@query("chk10_sql_functions", f"WITH {FIXED_SQL}, {TOKENS_SQL}, {SENTENCES_SQL} SELECT 'fixed_size' AS strategy, document_id, chunk_index, char_start, char_end FROM fixed UNION ALL SELECT 'token_window', * FROM windows UNION ALL SELECT 'sentence_window', * FROM sentence_windows")
def chk10_sql(spark, sf):
    """Three chunkers as table functions of SQL."""
    table_functions.register(spark)
    cut = "SELECT '{0}' AS strategy, document_id, c.chunk_index, c.char_start, c.char_end FROM {{docs}}, LATERAL chunk_{0}(text) c"
    return spark.sql(" UNION ALL ".join(cut.format(name) for name in ("fixed_size", "token_window", "sentence_window")), docs=documents(spark, sf).select("document_id", "text"))


@query("txt1_sanitize", r"SELECT doc_id AS document_id, md5(nfc_normalize(replace(replace(replace(text, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS digest FROM documents")
def txt1(spark, sf):
    return documents(spark, sf).select("document_id", F.md5(T.sanitized(F.col("text"))).alias("digest"))


@query("txt2_word_tokens", r"SELECT doc_id AS document_id, len(l)::BIGINT AS n_words, md5(array_to_string(l, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS l FROM documents)")
def txt2(spark, sf):
    rows = documents(spark, sf).withColumn("l", T.word_tokens(F.col("text")))
    return rows.select("document_id", F.size("l").cast("bigint").alias("n_words"), F.md5(F.array_join("l", " ")).alias("digest"))


@query("txt3_budget_tokens", r"SELECT doc_id AS document_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_tokens, (len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS line_count FROM documents")
def txt3(spark, sf):
    return documents(spark, sf).select("document_id", T.token_count(F.col("text")).alias("n_tokens"), T.line_count(F.col("text")).alias("line_count"))


#: The place of a text at or after a cursor, else its first place; null where there is none.
SOUGHT = "CASE WHEN instr(substring(d.text, (f.cursor + 1)::INT), {0}) > 0 THEN f.cursor + instr(substring(d.text, (f.cursor + 1)::INT), {0}) - 1 WHEN instr(d.text, {0}) > 0 THEN instr(d.text, {0}) - 1 END"


@query("txt4_locate_chunks", f"""WITH RECURSIVE {TOKENS_SQL.replace("window_texts AS", "window_texts AS MATERIALIZED")},
 found AS (SELECT doc_id AS document_id, -1::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS char_start, NULL::BIGINT AS char_end FROM documents
           UNION ALL
           SELECT document_id, k, CASE WHEN place IS NULL THEN 0 ELSE greatest(cursor, place + n) END, place, place + n FROM (
             SELECT f.document_id, f.k + 1 AS k, f.cursor, length(w.text) AS n, {SOUGHT.format("w.text")}::BIGINT AS place
             FROM found f JOIN window_texts w ON w.document_id = f.document_id AND w.chunk_index = f.k + 1 JOIN documents d ON d.doc_id = f.document_id))
 SELECT document_id, k AS chunk_index, char_start, char_end FROM found WHERE k >= 0""")
def txt4(spark, sf):
    rows = locate.located_exactly(windows(spark, sf).withColumn("strategy", F.lit("token_window")), documents(spark, sf))
    return rows.select("document_id", "chunk_index", "char_start", "char_end")


ENDS = "list_max(list_filter(range(((length(c.text) + 1) // 2)::BIGINT, length(c.text) + 1), lambda n: contains(d.text, {}(c.text, n::INT))))"
LOCATED_SQL = SENTENCE_SQL + f""",
 ends AS MATERIALIZED (SELECT c.document_id, chunk_index, c.text, contains(d.text, c.text) AS whole, CASE WHEN NOT whole THEN {ENDS.format("right")} END AS tail, CASE WHEN NOT whole THEN {ENDS.format("left")} END AS head
                       FROM chunks c JOIN documents d ON d.doc_id = c.document_id),
 found AS (SELECT doc_id AS document_id, -1::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS char_start, NULL::BIGINT AS char_end, 0::BIGINT AS covered_chars, false AS exact, 0::BIGINT AS n FROM documents
           UNION ALL
           SELECT document_id, k, CASE WHEN a IS NULL THEN 0 ELSE greatest(cursor, b) END, a, b, coalesce(covered, 0), whole, n FROM (
             SELECT document_id, k, cursor, whole, n, tail, head,
                    CASE WHEN whole THEN w WHEN joined THEN least(t, h) WHEN last THEN t ELSE h END::BIGINT AS a,
                    CASE WHEN whole THEN w + n WHEN joined THEN greatest(t + tail, h + head) WHEN last THEN t + tail ELSE h + head END::BIGINT AS b,
                    CASE WHEN whole THEN n WHEN joined THEN greatest(tail, head) WHEN last THEN tail ELSE head END::BIGINT AS covered
             FROM (SELECT *, tail IS NOT NULL AND head IS NOT NULL AND greatest(t, h) - least(t + tail, h + head) <= 2 * n AS joined, tail IS NOT NULL AND (head IS NULL OR tail >= head) AS last
                   FROM (SELECT f.document_id, f.k + 1 AS k, f.cursor, e.whole, length(e.text) AS n, e.tail, e.head, {SOUGHT.format("e.text")} AS w,
                                {SOUGHT.format("right(e.text, e.tail::INT)")} AS t, {SOUGHT.format("left(e.text, e.head::INT)")} AS h
                         FROM found f JOIN ends e ON e.document_id = f.document_id AND e.chunk_index = f.k + 1 JOIN documents d ON d.doc_id = f.document_id))))"""


@query("txt5_fuzzy_locate", LOCATED_SQL + " SELECT document_id, 'sentence_split' AS strategy, k AS chunk_index, coalesce(char_start, -1) AS char_start, coalesce(char_end, -1) AS char_end, covered_chars, exact FROM found WHERE k >= 0")
def txt5(spark, sf):
    chunks = chunkers.sentence_split(documents(spark, sf)).withColumn("strategy", F.lit("sentence_split"))
    return locate.located(chunks, documents(spark, sf)).drop("text").fillna(-1, ["char_start", "char_end"])


@query("txt7_localization", LOCATED_SQL + " SELECT document_id, round(avg((char_start IS NOT NULL)::INT), 6) AS localization_rate, round(sum(covered_chars) / sum(n), 6) AS localization_coverage FROM found WHERE k >= 0 GROUP BY 1")
def txt7(spark, sf):
    chunks = chunkers.sentence_split(documents(spark, sf)).withColumn("strategy", F.lit("sentence_split"))
    rows = locate.localization(locate.located(chunks, documents(spark, sf)), ["document_id"])
    return rows.select("document_id", number("localization_rate").alias("localization_rate"), number("localization_coverage").alias("localization_coverage"))


@query("txt8_sequential_search", SENTENCE_SQL + f""",
 held AS MATERIALIZED (SELECT document_id, chunk_index, text FROM chunks),
 found AS (SELECT doc_id AS document_id, -1::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS char_start, NULL::BIGINT AS char_end FROM documents
           UNION ALL
           SELECT document_id, k, coalesce(place + n, cursor), place, place + n FROM (
             SELECT f.document_id, f.k + 1 AS k, f.cursor, length(w.text) AS n, {SOUGHT.format("w.text")}::BIGINT AS place
             FROM found f JOIN held w ON w.document_id = f.document_id AND w.chunk_index = f.k + 1 JOIN documents d ON d.doc_id = f.document_id))
 SELECT document_id, k AS chunk_index, char_start, char_end FROM found WHERE char_start IS NOT NULL""")
def txt8(spark, sf):
    """Of sentence chunks, some of which aren't verbatim and are skipped."""
    chunks = chunkers.sentence_split(documents(spark, sf)).withColumn("strategy", F.lit("sentence_split"))
    return locate.located_sequentially(chunks, documents(spark, sf)).drop("strategy")


@query("gld6_finalize_clauses", f"WITH {CLAUSES_SQL} SELECT document_id, identifier, g_start, g_end FROM clauses")
def gld6(spark, sf):
    return clauses(spark, sf).select("document_id", "identifier", F.col("g_start").cast("bigint").alias("g_start"), F.col("g_end").cast("bigint").alias("g_end"))


@query("gld7_nearest_heading", f"WITH {CLAUSES_SQL} SELECT document_id, identifier, (SELECT max_by(x.identifier, x.k) FROM clauses x WHERE x.document_id = c.document_id AND x.is_top_level AND x.k < c.k) AS nearest FROM clauses c")
def gld7(spark, sf):
    return spans.nearest_preceding(clauses(spark, sf), F.col("is_top_level"), "identifier", "nearest").select("document_id", "identifier", "nearest")


@query("flt2_leaf_and_top", f"WITH {CLAUSES_SQL} SELECT document_id, count(*) FILTER (WHERE is_leaf) AS leaves, count(*) FILTER (WHERE is_top_level) AS tops, count(*) FILTER (WHERE is_leaf AND g_end - g_start >= 20) AS eligible FROM full_clauses GROUP BY 1")
def flt2(spark, sf):
    return full_clauses(spark, sf).groupBy("document_id").agg(F.count_if("is_leaf").alias("leaves"), F.count_if("is_top_level").alias("tops"), F.count_if(F.col("is_leaf") & (F.col("g_end") - F.col("g_start") >= 20)).alias("eligible"))


@query("jn16_subtree", f"WITH {CLAUSES_SQL} SELECT document_id, identifier, subtree_end FROM full_clauses")
def jn16(spark, sf):
    return full_clauses(spark, sf).select("document_id", "identifier", F.col("subtree_end").cast("bigint").alias("subtree_end"))


DEEP_SQL = f"""WITH RECURSIVE {CLAUSES_SQL},
 deep AS (SELECT document_id, k, CASE WHEN k > 0 THEN (k - 1) // 2 END AS up, g_end FROM clauses),
 below AS (SELECT document_id, k, k AS top, up, g_end FROM deep
           UNION ALL SELECT b.document_id, b.k, d.k, d.up, b.g_end FROM below b JOIN deep d ON d.document_id = b.document_id AND d.k = b.up)
 SELECT document_id, top AS k, max(g_end) AS subtree_end FROM below GROUP BY ALL"""


@query("jn16_deep_subtree", DEEP_SQL)
def jn16_deep(spark, sf):
    """Lines as a binary tree, as deep as the logarithm of their number."""
    k = F.col("k")
    rows = lines(spark, sf).select("document_id", "k", k.cast("string").alias("identifier"), F.when(k > 0, F.floor((k - 1) / 2).cast("string")).alias("parent"), "g_end")
    return spans.subtree_ends(rows).select("document_id", "k", "subtree_end")


@query("src2_lookup", "SELECT DISTINCT doc_id AS document_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def src2(spark, sf):
    return documents(spark, sf).where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en")).select("document_id", "source").distinct()


@query("src12_upload_checks", r"SELECT doc_id AS document_id, length(substring(text, 1, 200000))::BIGINT AS n_chars FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AND NOT contains(text, chr(0)) AND strlen(text) <= 102400")
def src12(spark, sf):
    from spanlab.sources.documents import accepted_uploads

    rows = documents(spark, sf).select("document_id", F.encode("text", "UTF-8").alias("content"))
    return accepted_uploads(rows).select("document_id", F.length("text").cast("bigint").alias("n_chars"))


@query("prj1_window_tokens", f"WITH {TOKENS_SQL} SELECT document_id, chunk_index, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_tokens FROM window_texts")
def prj1(spark, sf):
    return windows(spark, sf).select("document_id", "chunk_index", T.token_count(F.col("text")).alias("n_tokens"))


@query("prj3_document_key", r"SELECT conv_id, turn, CASE WHEN regexp_replace(q, '_q[0-9a-zA-Z]*$', '') = '' THEN q ELSE regexp_replace(q, '_q[0-9a-zA-Z]*$', '') END AS document_key, CASE WHEN starts_with(q, 'us_') THEN 'us' WHEN starts_with(q, 'eu_') THEN 'eu' ELSE 'uk' END AS jurisdiction FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'us_' WHEN 1 THEN 'eu_' ELSE '' END || role || '_q' || turn AS q FROM conversations)")
def prj3(spark, sf):
    prefix = F.when(F.col("turn") % 3 == 0, "us_").when(F.col("turn") % 3 == 1, "eu_").otherwise("")
    rows = table(spark, sf, "conversations").withColumn("q", F.concat(prefix, "role", F.lit("_q"), F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", T.document_key(F.col("q")).alias("document_key"), T.jurisdiction(F.col("q")).alias("jurisdiction"))


@query("agg10_size_variation", f"WITH {TOKENS_SQL} SELECT document_id, CASE WHEN count(*) < 2 OR avg(char_end - char_start) = 0 THEN 0 ELSE round(stddev_pop(char_end - char_start) / avg(char_end - char_start), 6) END AS size_cv FROM windows GROUP BY 1")
def agg10(spark, sf):
    return windows(spark, sf).groupBy("document_id").agg(number(size_variation(F.col("char_end") - F.col("char_start"))).alias("size_cv"))


@query("txt12_highlight", "SELECT doc_id AS document_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(the)', '<mark>\\1</mark>', 'gi')) AS digest FROM documents")
def txt12(spark, sf):
    return documents(spark, sf).select("document_id", F.md5(T.highlighted(F.col("text"), "the")).alias("digest"))


@query("agg25_mean_length", f"WITH {FIXED_SQL}, {TOKENS_SQL} SELECT 'fixed_size' AS strategy, round(avg(char_end - char_start), 6) AS mean_length FROM fixed UNION ALL SELECT 'token_window', round(avg(char_end - char_start), 6) FROM windows")
def agg25(spark, sf):
    both = chunkers.chunk(documents(spark, sf), ["fixed_size", "token_window"])
    return both.groupBy("strategy").agg(number(F.avg(F.col("char_end") - F.col("char_start"))).alias("mean_length"))
