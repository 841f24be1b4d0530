"""The queries of the operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.chat import chat_formatted, read_back
from spanlab.llm.divergence import source_divergence
from spanlab.llm.exact_dedup import exact_dedup
from spanlab.llm.fill_middle import fill_in_middle, restored
from spanlab.llm.language import identified
from spanlab.llm.line_dedup import line_deduplicated
from spanlab.llm.mixing import mixed
from spanlab.llm.neighbours import nearest
from spanlab.llm.packing import packed
from spanlab.llm.sharding import sharded
from spanlab.llm.simhash import near_duplicates
from spanlab.llm.token_counts import token_counts
from spanlab.llm.toxicity import toxicity
from spanlab.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the shard that it is in, and what the manifest says of that."""
    store = sharded(_table(spark, sf_dir, "documents"))
    rows = store.read(["doc_id", "text"])
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "shard", "shard_bytes", "shard_rows", "version")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, the runs of lines that go, and a digest of what stays."""
    rows = line_deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", "removed_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return rows.withColumns({name: F.sha2(text, 256) for name, text in digests.items()}).drop("output")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts spell control strings."""
    import public_tokenizers

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spelt = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(spelt).alias("text"),
    )
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return read_back(chat_formatted(rows.unionByName(own), *ranks), *ranks)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_sharding, op3_simhash, op4_language_id, op5_nearest_neighbours, op6_packing, op7_line_dedup, op8_toxicity, op9_token_counts, op10_mixing,
              op11_fill_in_middle, op12_chat_formatting, op13_source_divergence)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
                          sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
             h AS (SELECT *, len(l) AS n, ('0x' || d[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || d[9:16])::BIGINT % (len(l) + 1) AS b,
                          ('0x' || d[25:32])::BIGINT % 100 AS order_,
                          text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM t),
             c AS (SELECT *, array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m,
                          array_to_string(l[greatest(a, b) + 1:], '') AS s FROM h)
        SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN order_ < 50 THEN 'spm' ELSE 'psm' END AS form,
               CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
               sha256(CASE WHEN plain THEN text WHEN order_ < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m
                           ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
    "op12_chat_formatting": r"""
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
             told AS (SELECT *, md5(role || chr(10) || text) AS tie, role = 'assistant' AS learnt,
                             32 + length(role) + len(regexp_extract_all(role, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars
                      FROM said)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE learnt), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (WHERE learnt), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM told GROUP BY conv_id""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             o AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT k) >= 3),
             size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
             g AS (SELECT DISTINCT lang, source FROM d),
             counts AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
             own AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
             p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                          1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(own.total, 0) + v) AS p,
                          1 + 1000000000 * (kept.n + 1) // (size.total + v) AS q
                   FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
                        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
             terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
             sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
                       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                        FROM (FROM terms UNION ALL FROM pairs))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
