"""How the operators bind to the driver's tables, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions.text import piece_starts, substring
from spanlab.operators import chunkers, lexical, spans

#: name -> builder, and name -> SQL; filled by the modules beside this one.
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Over all cores, if the files have fewer row groups than there are cores; larger inputs are never shuffled for it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "document_id").drop("n_chars")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.token_window(documents(spark, sf_dir))


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.fixed_size(documents(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document, with its number k and its span; heading is its text."""
    docs = documents(spark, sf_dir).withColumn("lines", F.split("text", "\n", -1))
    docs = docs.withColumn("starts", piece_starts(F.transform("lines", lambda x: F.length(x) + 1), F.lit(0)))
    rows = docs.select("document_id", F.length("text").alias("n_chars"), F.posexplode(F.arrays_zip("lines", "starts")).alias("k", "z"))
    rows = rows.select("document_id", "n_chars", F.col("k").cast("bigint").alias("k"), F.col("z.starts").alias("g_start"), F.col("z.lines").alias("heading"))
    return spans.finalized(rows).drop("n_chars")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as clauses: every third is a top-level one, the two after it are its children."""
    named = lambda k: F.concat(F.lit("c"), k.cast("string"))
    k = F.col("k")
    parent = F.when(k % 3 > 0, named(k - k % 3)).alias("parent")
    return lines(spark, sf_dir).select("document_id", named(k).alias("identifier"), parent, (k % 3 == 0).alias("is_top_level"), "g_start", "heading", "g_end")


def full_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With is_leaf and subtree_end."""
    rows = clauses(spark, sf_dir).drop("heading")
    parents = rows.where("parent is not null").select("document_id", F.col("parent").alias("identifier"), F.lit(True).alias("_has")).distinct()
    rows = rows.join(parents, ["document_id", "identifier"], "left").withColumn("is_leaf", F.col("_has").isNull()).drop("_has")
    return spans.subtree_ends(rows)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim first occurrences of benchmark items: query_id, document_id, g_start, g_end."""
    return lexical.anchored(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir)).withColumnRenamed("item_id", "query_id")


def ranking(spark: SparkSession, sf_dir: str, depth: int = 5) -> DataFrame:
    """Lexical top of the token windows for each benchmark query, with text."""
    candidates = windows(spark, sf_dir)
    best = lexical.ranked(benchmark_queries(spark, sf_dir), candidates, depth, ["document_id", "char_start", "char_end"])
    # The texts of the best are cut from their documents again, not all candidates.
    texts = documents(spark, sf_dir).select("document_id", F.col("text").alias("_text"))
    return best.join(texts, "document_id").withColumn("text", substring(F.col("_text"), F.col("char_start"), F.col("char_end"))).drop("_text")


def number(x: Column | str, places: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, places)


# The same in SQL.
TOKENS_SQL = r"""
 pieces AS (SELECT doc_id, lead, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS j
            FROM (SELECT doc_id, length(regexp_extract(text, '^\s*')) AS lead, regexp_extract_all(text, '\S+\s*') AS l FROM documents)),
 tokens AS (SELECT doc_id, j, lead + sum(length(p)) OVER w - length(p) AS s,
                   lead + sum(length(p)) OVER w - length(regexp_extract(p, '\s*$')) AS e, count(*) OVER (PARTITION BY doc_id) AS n
            FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
 windows AS (SELECT t.doc_id AS document_id, w.w AS chunk_index, min(s)::BIGINT AS char_start, max(e)::BIGINT AS char_end
             FROM tokens t, LATERAL (SELECT j // 56 AS w UNION ALL SELECT j // 56 - 1) w
             WHERE w.w >= 0 AND j < w.w * 56 + 64 AND (w.w = 0 OR w.w * 56 < n - 8) GROUP BY 1, 2),
 window_texts AS (SELECT w.*, substring(text, (char_start + 1)::INT, (char_end - char_start)::INT) AS text
                  FROM windows w JOIN documents d ON d.doc_id = w.document_id)"""

FIXED_SQL = r"""
 fixed AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY a) - 1 AS chunk_index, a AS char_start, b AS char_end, text
           FROM (SELECT doc_id AS document_id, i * 512 AS a, least(i * 512 + 512, length(d.text)) AS b, substring(d.text, (i * 512 + 1)::INT, 512) AS text
                 FROM documents d, LATERAL (SELECT unnest(range(0, (length(d.text) + 511) // 512)) AS i))
           WHERE regexp_matches(text, '\S'))"""

CLAUSES_SQL = """
 lines AS (SELECT doc_id AS document_id, length(text) AS n_chars, unnest(l) AS heading, generate_subscripts(l, 1) - 1 AS k
           FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
 starts AS (SELECT *, sum(length(heading) + 1) OVER (PARTITION BY document_id ORDER BY k) - length(heading) - 1 AS g_start FROM lines),
 clauses AS (SELECT document_id, 'c' || k AS identifier, CASE WHEN k % 3 > 0 THEN 'c' || (k - k % 3) END AS parent, k % 3 = 0 AS is_top_level,
                    g_start::BIGINT AS g_start, heading, coalesce(lead(g_start) OVER (PARTITION BY document_id ORDER BY k), n_chars)::BIGINT AS g_end, k FROM starts),
 full_clauses AS (SELECT c.*, NOT EXISTS (FROM clauses x WHERE x.document_id = c.document_id AND x.parent = c.identifier) AS is_leaf,
                         greatest(c.g_end, coalesce((SELECT max(x.g_end) FROM clauses x WHERE x.document_id = c.document_id AND x.parent = c.identifier), c.g_end)) AS subtree_end
                  FROM clauses c)"""

RANKING_SQL = TOKENS_SQL + r""",
 asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS token FROM benchmark),
 q_counts AS (SELECT query_id, token, count(*) AS n FROM asked GROUP BY ALL),
 posted AS (SELECT document_id, char_start, char_end, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS token FROM window_texts),
 c_counts AS (SELECT document_id, char_start, char_end, token, count(*) AS n FROM posted GROUP BY ALL),
 dots AS (SELECT query_id, document_id, char_start, char_end, sum(q.n * c.n) AS dot FROM q_counts q JOIN c_counts c USING (token) GROUP BY ALL),
 scored AS (SELECT d.*, dot / ((SELECT sqrt(sum(n * n)) FROM q_counts q WHERE q.query_id = d.query_id) * cn.norm) AS score
            FROM dots d JOIN (SELECT document_id, char_start, char_end, sqrt(sum(n * n)) AS norm FROM c_counts GROUP BY ALL) cn USING (document_id, char_start, char_end)),
 all_ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, char_start, char_end) AS rank FROM scored),
 evidence AS (SELECT item_id AS query_id, doc_id AS document_id, (instr(d.text, b.text) - 1)::BIGINT AS g_start, (instr(d.text, b.text) - 1 + length(b.text))::BIGINT AS g_end
              FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

CLIPPED_SQL = RANKING_SQL + r""",
 ranking AS (SELECT r.*, text, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM all_ranks r JOIN window_texts USING (document_id, char_start, char_end) WHERE rank <= 5),
 budget AS (SELECT *, least(n_tokens, 128 - coalesce(sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS tokens FROM ranking),
 clipped AS (SELECT query_id, rank, document_id, char_start, tokens::BIGINT AS tokens,
                    (char_start + length(regexp_extract(text, '^\s*(?:\S+\s+){' || (tokens - 1)::INT || '}\S+')))::BIGINT AS char_end
             FROM budget WHERE tokens > 0)"""
