"""Ranking metrics, vectors and their joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import retrieval as R, vector as V
from spanlab.operators.validate import candidate_violations, vector_violations
from spanlab.plans.tables import RANKING_SQL, benchmark_queries, documents, evidence, number, query, ranking, spread, table

DEPTH = 10
HITS_SQL = RANKING_SQL + f""",
 hits AS (SELECT query_id, rank, document_id, char_start, char_end FROM all_ranks WHERE rank <= {DEPTH}),
 sections AS (SELECT query_id, document_id, g_start, g_end, query_id % 3 + 1 AS grade, row_number() OVER (PARTITION BY query_id ORDER BY document_id) - 1 AS no FROM evidence),
 overlapping AS (SELECT query_id, rank, document_id, no, grade, g_end - g_start AS len, greatest(0, least(char_end, g_end) - greatest(char_start, g_start)) AS ov FROM hits JOIN sections USING (query_id, document_id)),
 matched AS (SELECT * FROM overlapping WHERE ov > 0 AND CASE WHEN len < 100 THEN 2 * ov >= len ELSE ov >= 100 END)"""


def hits(spark, sf):
    rows = ranking(spark, sf, DEPTH).select("query_id", "rank", "document_id", "char_start", "char_end")
    return rows.withColumn("chunk_id", F.concat_ws(":", "document_id", "char_start")).withColumn("ord", F.col("rank"))


def sections(spark, sf):
    rows = evidence(spark, sf).withColumn("grade", (F.col("query_id") % 3 + 1).cast("int"))
    return rows.withColumn("section_id", F.lit("whole")).withColumn("ord", F.col("document_id"))


@query("rm1_relevance", f"WITH {HITS_SQL} SELECT query_id, rank, max(grade)::BIGINT AS grade FROM matched GROUP BY ALL")
def rm1(spark, sf):
    found = R.matches(hits(spark, sf), R.usable_sections(sections(spark, sf)))
    return found.groupBy("query_id", F.col("rank").cast("bigint").alias("rank")).agg(F.max("grade").cast("bigint").alias("grade"))


METRICS_SQL = HITS_SQL + f""",
 q AS (SELECT item_id AS query_id FROM benchmark),
 total AS (SELECT query_id, count(*) AS total FROM sections GROUP BY 1),
 rel AS (SELECT query_id, count(DISTINCT rank) AS retrieved, min(rank) AS first FROM matched GROUP BY 1),
 per AS (SELECT q.query_id, k, (SELECT count(DISTINCT rank) FROM matched m WHERE m.query_id = q.query_id AND rank <= k) AS rel,
                (SELECT count(DISTINCT no) FROM matched m WHERE m.query_id = q.query_id AND rank <= k) AS sec,
                (SELECT max(rank) FROM hits h WHERE h.query_id = q.query_id AND rank <= k) AS deep FROM q, (VALUES (1), (3), (5), (10)) t(k)),
 wide AS (SELECT query_id, {", ".join(f"max(CASE WHEN deep > 0 THEN rel / least(k, deep) ELSE 0 END) FILTER (WHERE k = {k}) AS p{k}, max(sec) FILTER (WHERE k = {k}) AS s{k}" for k in R.KS)} FROM per GROUP BY 1),
 wrong AS (SELECT query_id, count(*) AS n FROM hits h WHERE NOT EXISTS (FROM sections s WHERE s.query_id = h.query_id AND s.document_id = h.document_id) GROUP BY 1)"""


ASSIGNMENT_SQL = """
 weights AS MATERIALIZED (SELECT DISTINCT query_id, rank, no, (2.0 ** grade - 1) / log2(rank + 1) AS w FROM matched WHERE rank <= 10),
 states AS (SELECT item_id AS query_id, 0::BIGINT AS rank, 0::BIGINT AS mask, 0.0::DOUBLE AS total FROM benchmark
            UNION ALL
            SELECT query_id, rank + 1, mask, max(total) FROM (
              SELECT s.query_id, s.rank, s.mask, s.total FROM states s WHERE s.rank < 10
              UNION ALL SELECT s.query_id, s.rank, s.mask + (1::BIGINT << w.no::INT), s.total + w.w FROM states s JOIN weights w ON w.query_id = s.query_id AND w.rank = s.rank + 1 WHERE s.rank < 10 AND (s.mask >> w.no::INT) % 2 = 0)
            GROUP BY 1, 2, 3),
 best AS (SELECT query_id, rank AS k, max(total) AS gain FROM states WHERE rank IN (1, 3, 5, 10) GROUP BY ALL),
 ideal AS (SELECT query_id, k, sum((2.0 ** grade - 1) / log2(place + 1)) AS total FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM sections), (VALUES (1), (3), (5), (10)) t(k) WHERE place <= k GROUP BY ALL),
 ndcg AS (SELECT query_id, k, gain / total AS ndcg FROM best JOIN ideal USING (query_id, k))"""


def at_each(name, sql):
    return ", ".join(f"round({sql.format(k=k)}, 6) AS {name}_at_{k}" for k in R.KS)


NDCG_AT = "coalesce((SELECT ndcg FROM ndcg x WHERE x.query_id = wide.query_id AND k = {k}), 0)"


@query("rm2_rm8_metrics", f"WITH RECURSIVE {METRICS_SQL}, {ASSIGNMENT_SQL} SELECT query_id, {at_each('precision', 'p{k}')}, {at_each('recall', 'CASE WHEN total > 0 THEN s{k} / total ELSE 1 END')}, {at_each('ndcg', NDCG_AT)}, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(n, 0) / 10, 6) AS drm, coalesce(n, 0) > 0 AS drm_hit, coalesce(retrieved, 0) AS relevant_retrieved, coalesce(total, 0) AS total_relevant FROM wide LEFT JOIN total USING (query_id) LEFT JOIN rel USING (query_id) LEFT JOIN wrong USING (query_id)")
def rm28(spark, sf):
    rows = R.metrics(benchmark_queries(spark, sf), hits(spark, sf), sections(spark, sf))
    numbers = [f"{name}_at_{k}" for name in ("precision", "recall", "ndcg") for k in R.KS] + ["mrr", "drm"]
    return rows.select("query_id", *[number(c).alias(c) for c in numbers], "drm_hit", "relevant_retrieved", "total_relevant")


@query("rm5_assignment_ndcg", f"WITH RECURSIVE {HITS_SQL}, {ASSIGNMENT_SQL} SELECT query_id, round(ndcg, 6) AS ndcg FROM ndcg WHERE k = 10")
def rm5(spark, sf):
    return R.ndcg(hits(spark, sf), sections(spark, sf), (10,)).select("query_id", number("ndcg_at_10").alias("ndcg"))


@query("agg9_retrieval_means", f"WITH {METRICS_SQL} SELECT query_id % 2 AS half, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(p10), 6) AS precision_at_10, round(avg(coalesce(n, 0) / 10), 6) AS drm FROM wide LEFT JOIN rel USING (query_id) LEFT JOIN wrong USING (query_id) GROUP BY 1")
def agg9(spark, sf):
    rows = R.metrics(benchmark_queries(spark, sf), hits(spark, sf), sections(spark, sf))
    return rows.groupBy((F.col("query_id") % 2).alias("half")).agg(*[number(F.avg(c)).alias(c) for c in ("mrr", "precision_at_10", "drm")])


@query("win4_rank_normalisation", f"WITH {HITS_SQL} SELECT query_id, count(*) AS kept, max(rank) AS deepest FROM hits GROUP BY 1")
def win4(spark, sf):
    """Every hit twice, as an external run might have it."""
    rows = hits(spark, sf)
    return R.normalized_hits(rows.unionByName(rows.withColumn("ord", F.col("ord") + 100)), 10).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.max("rank").cast("bigint").alias("deepest"))


@query("flt4_usable_sections", f"WITH {HITS_SQL} SELECT query_id, count(*) AS n, max(grade)::BIGINT AS top FROM sections GROUP BY 1")
def flt4(spark, sf):
    rows = sections(spark, sf)
    doubled = rows.unionByName(rows.withColumn("grade", F.lit(0))).unionByName(rows.withColumn("g_end", F.col("g_start")))
    return R.usable_sections(doubled).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("grade").cast("bigint").alias("top"))


@query("flt5_malformed_gold", f"WITH {HITS_SQL} SELECT query_id, true AS malformed FROM sections WHERE query_id % 2 = 0 GROUP BY 1 UNION ALL SELECT query_id, false FROM sections WHERE query_id % 2 = 1 GROUP BY 1")
def flt5(spark, sf):
    rows = sections(spark, sf)
    return R.malformed_queries(rows.withColumn("g_end", F.when(F.col("query_id") % 2 == 0, F.col("g_start")).otherwise(F.col("g_end"))))


@query("rm9_text_relevance", r"WITH w AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda x: length(x) > 4) AS l FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT query_id, doc_id, len(l) AS n, len(list_filter(l, lambda x: contains(t, x))) AS found FROM w, d WHERE len(l) > 0) SELECT query_id, count(*) AS relevant FROM p WHERE 2 * found >= n GROUP BY 1")
def rm9(spark, sf):
    """A document is relevant if it holds half of the query's long words."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), lambda w: F.length(w) > 4)
    asked = benchmark_queries(spark, sf).select("query_id", words.alias("l")).where("size(l) > 0")
    wanted = asked.select("query_id", F.size("l").alias("n"), F.explode("l").alias("word"))
    # A word has no break inside, so a text contains it just if one of its tokens does: tokens, met once each, give up their pieces.
    tokens = documents(spark, sf).select("document_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("token")).where(F.length("token") > 4)
    longest = wanted.agg(F.coalesce(F.max(F.length("word")), F.lit(5)).alias("longest"))
    known = tokens.select("token").distinct().join(F.broadcast(longest))
    sizes = known.select("token", F.explode(F.sequence(F.lit(5), F.least(F.length("token"), F.col("longest")))).alias("size"))
    pieces = sizes.select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - F.col("size") + 1), lambda i: F.substring("token", i, F.col("size")))).alias("word"))
    holding = pieces.join(wanted.select("word").distinct(), "word").distinct()
    found = tokens.join(holding, "token").select("document_id", "word").distinct().join(wanted, "word")
    held = found.groupBy("query_id", "n", "document_id").agg(F.count(F.lit(1)).alias("found")).where("2 * found >= n")
    return held.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))


TEXT_SQL = HITS_SQL + r""",
 words AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), lambda x: length(x) > 4) AS l FROM benchmark),
 told AS (SELECT h.query_id, h.rank, len(l) > 0 AND 2 * len(list_filter(l, lambda x: contains(lower(w.text), x))) >= len(l) AS relevant
          FROM hits h JOIN window_texts w USING (document_id, char_start, char_end) JOIN words USING (query_id)),
 of_all AS (SELECT query_id, count(*) FILTER (WHERE relevant) AS n, min(rank) FILTER (WHERE relevant) AS first FROM told GROUP BY 1)"""
GAIN_SQL = "coalesce((SELECT sum(1 / log2(rank + 1)) FROM told t WHERE t.query_id = o.query_id AND relevant AND rank <= {k}), 0)"


@query("rm9_text_metrics", f"WITH {TEXT_SQL} SELECT query_id, " + ", ".join(f"round((SELECT count(*) FROM told t WHERE t.query_id = o.query_id AND relevant AND rank <= {k}) / {k}, 6) AS precision_at_{k}, round(CASE WHEN n > 0 THEN {GAIN_SQL.format(k=k)} / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, {k}) + 1) x(i)) ELSE 0 END, 6) AS ndcg_at_{k}" for k in R.KS) + ", round(coalesce(1 / first, 0), 6) AS mrr FROM of_all o")
def rm9_metrics(spark, sf):
    """Of the best windows for each query those are relevant that hold half of its long words."""
    best = ranking(spark, sf, DEPTH).select("query_id", "rank", "text")
    told = best.join(benchmark_queries(spark, sf).withColumnRenamed("text", "asked"), "query_id")
    rows = R.relevance_metrics(told.select("query_id", "rank", R.describes(F.col("text"), F.col("asked")).alias("relevant")), ["query_id"])
    return rows.select("query_id", *[number(c).alias(c) for c in rows.columns[1:]])


DOTS_SQL = """
 q AS (SELECT vec_id AS query_id, label AS q_label, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
 pairs AS (SELECT query_id, q_label, vec_id, label, list_sum(list_transform(list_zip(q, embedding::DOUBLE[]), lambda z: z[1] * z[2])) AS score FROM q, embeddings WHERE vec_id <> query_id),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 10)"""


def vector_hits(spark, sf):
    rows = spread(table(spark, sf, "embeddings"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_k(asked, rows.select("vec_id", F.col("embedding").alias("vec")), 11).where("vec_id <> query_id")


@query("win2_vector_top_k", f"WITH {DOTS_SQL} SELECT query_id, vec_id, round(score, 6) AS score FROM top")
def win2(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return vector_hits(spark, sf).withColumn("r", F.row_number().over(order)).where("r <= 10").select("query_id", "vec_id", number("score").alias("score"))


@query("jn7_vector_scores", "SELECT q.vec_id AS query_id, e.label, round(max(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda z: z[1] * z[2]))), 6) AS best FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 GROUP BY ALL")
def jn7(spark, sf):
    rows = spread(table(spark, sf, "embeddings"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = V.scored(asked, rows.select("label", F.col("embedding").alias("vec")), "label")
    return best.select("query_id", "label", number("score").alias("best"))


@query("jn12_dense_grid", "SELECT s.strategy, m.model, item_id AS query_id FROM (VALUES ('fixed_size'), ('token_window'), ('sentence_split')) s(strategy), (VALUES ('a'), ('b')) m(model), benchmark WHERE (s.strategy, m.model) IN (SELECT ['fixed_size', 'token_window', 'sentence_split'][label % 3 + 1], ['a', 'b'][label % 2 + 1] FROM embeddings WHERE label < 5)")
def jn12(spark, sf):
    """An index for some pairs of strategy and model only."""
    rows = indexes(spark, sf).where("label < 5")
    return R.grid(["fixed_size", "token_window", "sentence_split"], ["a", "b"], benchmark_queries(spark, sf), rows).select("strategy", "model", "query_id")


def indexes(spark, sf):
    """Vectors of six indexes: strategy, model, vec_id, vec."""
    strategy = F.element_at(F.array(*map(F.lit, ("fixed_size", "token_window", "sentence_split"))), (F.col("label") % 3 + 1).cast("int"))
    model = F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("label") % 2 + 1).cast("int"))
    return table(spark, sf, "embeddings").select(strategy.alias("strategy"), model.alias("model"), "vec_id", "label", F.col("embedding").alias("vec"))


@query("val10_vector_dimensions", "SELECT vec_id::VARCHAR AS document_id, 'vector length' AS what FROM embeddings WHERE vec_id % 11 = 4 OR vec_id % 13 = 5")
def val10(spark, sf):
    """Some vectors are short, some are missing."""
    vec = F.when(F.col("vec_id") % 13 == 5, F.lit(None)).when(F.col("vec_id") % 11 == 4, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    rows = table(spark, sf, "embeddings")
    dim = len(rows.select("embedding").first()[0])
    return vector_violations(rows.select("vec_id", vec.alias("vec")), dim)


HASHED_SQL = r"SELECT doc_id AS owner_id, p, count(*) AS n FROM (SELECT doc_id, ('0x' || substring(md5(w), 1, 8))::BIGINT % 64 AS p FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS w FROM documents)) GROUP BY ALL"


@query("em1_hashed_embedder", f"WITH c AS ({HASHED_SQL}) SELECT owner_id, p AS place, round((n / sqrt(sum(n * n) OVER (PARTITION BY owner_id)))::FLOAT::DOUBLE, 5) AS x FROM c")
def em1(spark, sf):
    rows = documents(spark, sf).select(F.col("document_id").alias("owner_id"), "text")
    return V.embedded(rows).select("owner_id", F.posexplode("vec").alias("place", "x")).where("x > 0").select("owner_id", F.col("place").cast("bigint").alias("place"), number(F.col("x").cast("double"), 5).alias("x"))


@query("src13_cache_split", "SELECT doc_id % 2 = 0 AS hit, count(*) AS n FROM documents WHERE text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) GROUP BY 1")
def src13(spark, sf):
    rows = documents(spark, sf).select(F.col("document_id").alias("owner_id"), "text")
    single = rows.join(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("text"), "text")
    keyed = single.withColumn("text_key", F.sha2(F.concat_ws(":", F.lit("hashed_64"), "text"), 256))
    cache = keyed.where("owner_id % 2 = 0").select(F.lit("hashed_64").alias("model"), "text_key", F.array(F.lit(1.0).cast("float")).alias("vec"))
    hit, miss = V.cache_split(single, cache, "hashed_64")
    both = hit.select(F.lit(True).alias("hit")).unionByName(miss.select(F.lit(False).alias("hit")))
    return both.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


REGISTRY_SQL = "rows AS (SELECT ['fixed_size', 'token_window', 'sentence_split'][label % 3 + 1] AS strategy, ['a', 'b'][label % 2 + 1] AS model, * FROM embeddings)"


@query("em5_index_registry", f"WITH {REGISTRY_SQL} SELECT strategy, model, count(*) AS n_vectors, len(any_value(embedding))::BIGINT AS dim FROM rows GROUP BY ALL")
def em5(spark, sf):
    return V.registered(indexes(spark, sf))


@query("em5_search_of_one_index", f"WITH {REGISTRY_SQL}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), pairs AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding::DOUBLE[]), lambda z: z[1] * z[2])) AS score FROM q, rows WHERE strategy = 'token_window' AND model = 'b') SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 5")
def em5_search(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = V.top_k(asked, V.index_of(indexes(spark, sf), "token_window", "b"), 5)
    return hits.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query("drm_by_strategy", f"WITH {DOTS_SQL} SELECT query_id % 5 AS document_id, round(avg((vec_id % 5 <> query_id % 5)::INT), 6) AS drm FROM top GROUP BY 1")
def drm_by_strategy(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = vector_hits(spark, sf).withColumn("r", F.row_number().over(order)).where("r <= 10")
    return rows.groupBy((F.col("query_id") % 5).alias("document_id")).agg(number(F.avg((F.col("vec_id") % 5 != F.col("query_id") % 5).cast("int"))).alias("drm"))


@query("val6_candidate_ids", f"WITH {RANKING_SQL}, top AS (SELECT *, document_id || ':' || char_start AS id FROM all_ranks WHERE rank <= 5), kept AS (SELECT document_id, id, query_id, rank FROM top QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_id, rank) = 1) SELECT document_id::VARCHAR AS document_id, 'repeated candidate ' || id AS what FROM kept WHERE query_id % 5 = 0 UNION ALL SELECT document_id::VARCHAR, 'span of ' || id FROM kept, (SELECT unnest(range(0, 2)) AS copy) WHERE rank = 2 AND (copy = 0 OR query_id % 5 = 0)")
def val6(spark, sf):
    """Each candidate once, but for some that stand twice and some whose span is a character too long."""
    from pyspark.sql import Window

    rows = ranking(spark, sf).withColumn("id", F.concat_ws(":", "document_id", "char_start"))
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("query_id", "rank"))).where("n = 1")
    once = once.withColumn("char_end", F.col("char_end") + (F.col("rank") == 2).cast("int"))
    return candidate_violations(once.unionByName(once.where("query_id % 5 = 0")))
