"""Extraction, identifiers, headings, definitions, references and the legacy metrics over the driver's documents.

The driver's documents have hardly any numbering, so these queries put some in: the lines of a document become numbered
clauses ("3. …", "3.1 …") with a reference to the clause before and a definition.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlab.functions import identifiers as I, text as T
from spanlab.operators import chunkers, clause_aware, extract, legacy, structural as S
from spanlab.operators.containment import compare_profiles
from spanlab.plans.tables import documents, number, query


def numbered(spark, sf):
    """document_id, text, numbering_style: each line a paragraph, every third a top-level clause."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    head = lambda i: F.concat((F.floor(i / 3) + 1).cast("string"), F.when(i % 3 == 0, F.lit(". ")).otherwise(F.concat(F.lit("."), (i % 3).cast("string"), F.lit(" "))))
    told = lambda x, i: F.concat(head(i), F.when(i % 3 == 1, F.lit('"Term" means a thing. ')).otherwise(F.concat(F.lit("See clause "), (F.floor(i / 3) + 1).cast("string"), F.lit(". "))), x)
    return documents(spark, sf).select("document_id", F.array_join(F.transform(lines, told), "\n\n").alias("text"), F.lit("uk_decimal").alias("numbering_style"))


LINES_SQL = r"""
 lines AS (SELECT doc_id AS document_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)),
 told AS (SELECT *, CASE WHEN i % 3 = 0 THEN (i // 3 + 1) || '. ' ELSE (i // 3 + 1) || '.' || (i % 3) || ' ' END AS head,
                 CASE WHEN i % 3 = 1 THEN '"Term" means a thing. ' ELSE 'See clause ' || (i // 3 + 1) || '. ' END AS says FROM lines),
 sized AS (SELECT *, length(head || says || line) AS n FROM told),
 gold AS (SELECT *, (sum(n + 2) OVER (PARTITION BY document_id ORDER BY i) - n - 2)::BIGINT AS start, CASE WHEN i % 3 = 0 THEN (i // 3 + 1)::VARCHAR ELSE (i // 3 + 1) || '.' || (i % 3) END AS identifier,
                 CASE WHEN i % 3 > 0 THEN (i // 3 + 1)::VARCHAR END AS parent FROM sized),
 ended AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY i), start + n)::BIGINT AS stop FROM gold)"""


@query("gld2_uk_decimal", f"WITH {LINES_SQL} SELECT document_id, identifier, parent, start AS g_start, stop AS g_end FROM ended")
def gld2(spark, sf):
    rows = extract.clause_table(extract.extracted(numbered(spark, sf))).where("level < 3")
    return rows.select("document_id", "identifier", "parent", "g_start", F.col("g_end").cast("bigint").alias("g_end"))


def styled(spark, sf, style, head, prefix="", gap=lambda i: F.lit("\n\n"), told=lambda x: x):
    """document_id, text, numbering_style: each line that isn't blank behind a head for its number, and a gap after it."""
    some = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    text = F.concat(F.lit(prefix), F.array_join(F.transform(some, lambda x, i: F.concat(head(i), told(x), gap(i))), ""))
    return documents(spark, sf).select("document_id", text.alias("text"), F.lit(style).alias("numbering_style"))


def styled_sql(head, identifier, parent, level, clauses="true", prefix="", gap="chr(10) || chr(10)", told="line", opening="", columns=""):
    """The clauses of `styled` texts, those of the prefix (opening: rows of identifier, parent, level and start) included."""
    return rf"""
     WITH lines AS (SELECT doc_id AS document_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i
                    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)),
      told AS (SELECT *, {head} AS head, {told} AS says, {gap} AS gap FROM lines),
      placed AS (SELECT *, {len(prefix)} + sum(length(head || says || gap)) OVER (PARTITION BY document_id ORDER BY i) - length(head || says || gap) AS start FROM told),
      sized AS (SELECT doc_id AS document_id, {len(prefix)} + coalesce((SELECT sum(length(head || says || gap)) FROM told t WHERE t.document_id = doc_id), 0) AS size FROM documents),
      opened AS (SELECT document_id, {identifier} AS identifier, {parent} AS parent, {level} AS level, start, says FROM placed WHERE {clauses}
                 {" ".join(f"UNION ALL SELECT doc_id, '{n}', {p}, {l}, {at}, '' FROM documents" for n, p, l, at in opening)})
     SELECT document_id, identifier, parent, level::INTEGER AS level, start::BIGINT AS g_start,
            coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start), size)::BIGINT AS g_end{columns} FROM opened JOIN sized USING (document_id)"""


def styled_clauses(docs):
    rows = extract.clause_table(extract.extracted(docs))
    return rows.select("document_id", "identifier", "parent", "level", "g_start", F.col("g_end").cast("bigint").alias("g_end"))


def nth(i, size):
    """The number from 1 of a group of so many lines, as text."""
    return (F.floor(i / size) + 1).cast("string")


EU_PREFIX = "(1) Whereas.\n\nCHAPTER I\nAll\n\n"


@query(
    "gld1_eu_regulation",
    styled_sql(
        "CASE WHEN i % 4 = 0 THEN 'Article ' || (i // 4 + 1) || chr(10) ELSE (i % 4) || '. ' END", "'article_' || (i // 4 + 1) || CASE WHEN i % 4 > 0 THEN '_' || (i % 4) ELSE '' END",
        "CASE WHEN i % 4 = 0 THEN 'chapter_1' ELSE 'article_' || (i // 4 + 1) END", "CASE WHEN i % 4 = 0 THEN 2 ELSE 3 END",
        prefix=EU_PREFIX, opening=[("recital_1", "NULL", 1, 0), ("chapter_1", "NULL", 1, EU_PREFIX.index("CHAPTER"))],
    ),
)
def gld1(spark, sf):
    """A recital and a chapter, then articles of a heading and three items."""
    head = lambda i: F.when(i % 4 == 0, F.concat(F.lit("Article "), nth(i, 4), F.lit("\n"))).otherwise(F.concat((i % 4).cast("string"), F.lit(". ")))
    return styled_clauses(styled(spark, sf, "eu_regulation", head, EU_PREFIX))


@query(
    "gld3_us_article_section",
    styled_sql(
        "CASE WHEN i % 3 = 0 THEN 'Section 1.' || (i // 3 + 1) || ' ' ELSE '(' || chr((96 + i % 3)::INT) || ') ' END",
        "'section_1.' || (i // 3 + 1) || CASE WHEN i % 3 > 0 THEN '(' || chr((96 + i % 3)::INT) || ')' ELSE '' END",
        "CASE WHEN i % 3 = 0 THEN 'article_1' ELSE 'section_1.' || (i // 3 + 1) END", "CASE WHEN i % 3 = 0 THEN 2 ELSE 3 END",
        prefix="ARTICLE I\nAll\n\n", opening=[("article_1", "NULL", 1, 0)],
    ),
)
def gld3(spark, sf):
    """One article of sections with two items each."""
    head = lambda i: F.when(i % 3 == 0, F.concat(F.lit("Section 1."), nth(i, 3), F.lit(" "))).when(i % 3 == 1, "(a) ").otherwise("(b) ")
    return styled_clauses(styled(spark, sf, "us_article_section", head, "ARTICLE I\nAll\n\n"))


@query(
    "gld4_us_section_decimal",
    styled_sql(
        "CASE i % 3 WHEN 0 THEN 'Section ' || (i // 3 + 1) || '. ' WHEN 1 THEN 'Section ' || (i // 3 + 1) || '.1 ' ELSE '(a) ' END",
        "'section_' || (i // 3 + 1) || CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.1(a)' END",
        "CASE i % 3 WHEN 1 THEN 'section_' || (i // 3 + 1) WHEN 2 THEN 'section_' || (i // 3 + 1) || '.1' END", "i % 3 + 1",
    ),
)
def gld4(spark, sf):
    """Sections of one sub-section with one item."""
    section = lambda i: F.concat(F.lit("Section "), nth(i, 3))
    head = lambda i: F.when(i % 3 == 0, F.concat(section(i), F.lit(". "))).when(i % 3 == 1, F.concat(section(i), F.lit(".1 "))).otherwise("(a) ")
    return styled_clauses(styled(spark, sf, "us_section_decimal", head))


@query(
    "gld5_lettered_items",
    styled_sql(
        "CASE WHEN i % 6 = 0 THEN '1.' || (i // 6 + 1) || ' ' ELSE '(' || substring('abdef', (i % 6)::INT, 1) || ') ' END",
        "'1.' || (i // 6 + 1) || CASE WHEN i % 6 > 0 THEN '(' || substring('abdef', (i % 6)::INT, 1) || ')' ELSE '' END",
        "CASE WHEN i % 6 > 0 THEN '1.' || (i // 6 + 1) END", "CASE WHEN i % 6 = 0 THEN 2 ELSE 3 END", clauses="i % 6 < 3",
    ),
)
def gld5(spark, sf):
    """Lists of a, b, d, e and f: without a c they end at b."""
    letter = lambda i: F.substring(F.lit("abdef"), (i % 6).cast("int"), F.lit(1))
    head = lambda i: F.when(i % 6 == 0, F.concat(F.lit("1."), nth(i, 6), F.lit(" "))).otherwise(F.concat(F.lit("("), letter(i), F.lit(") ")))
    return styled_clauses(styled(spark, sf, "uk_decimal", head))


@query(
    "gld10_wrapped_headings",
    styled_sql(
        "(i + 1) || '. '", "(i + 1)::VARCHAR", "NULL::VARCHAR", "1", clauses="i = 0 OR (i - 1) % 5 <> 4",
        gap="CASE WHEN i % 5 = 4 THEN chr(10) || ' ' || chr(10) ELSE chr(10) || chr(10) END", told=r"regexp_replace(line, '(\S)\s+(\S)', '\1' || chr(10) || '\2')",
        columns=r", substring(regexp_replace(regexp_replace(says, '^[\s:–—-]+|[\s:–—-]+$', '', 'g'), '\s+', ' ', 'g'), 1, 120) AS heading",
    ),
)
def gld10_wrapped(spark, sf):
    """Each clause's text is wrapped after its first word; after each fifth there is a line of white space only, so that the
    next clause starts no paragraph."""
    gap = lambda i: F.when(i % 5 == 4, "\n \n").otherwise("\n\n")
    told = lambda x: F.regexp_replace(x, r"^([\s\S]*?\S)\s+(\S)", "$1\n$2")
    docs = styled(spark, sf, "uk_decimal", lambda i: F.concat((i + 1).cast("string"), F.lit(". ")), gap=gap, told=told)
    rows = extract.clause_table(extract.extracted(docs))
    return rows.select("document_id", "identifier", "parent", "level", "g_start", F.col("g_end").cast("bigint").alias("g_end"), "heading")


@query("gld8_defined_terms", f"WITH {LINES_SQL} SELECT document_id, 'Term' AS term, start + length(head) AS definition_start, start + n AS definition_end FROM gold WHERE i % 3 = 1")
def gld8(spark, sf):
    return extract.term_table(numbered(spark, sf)).where("term = 'Term'")


@query("gld9_references", f"WITH {LINES_SQL} SELECT document_id, (i // 3 + 1)::VARCHAR AS target, start + length(head) + length('See clause ') AS ref_start, (i // 3 + 1)::VARCHAR AS raw_text FROM gold WHERE i % 3 <> 1")
def gld9(spark, sf):
    refs = extract.reference_table(extract.extracted(numbered(spark, sf))).where("kind = 'internal_clause' AND target IS NOT NULL")
    return refs.select("document_id", "target", "ref_start", "raw_text")


NUMERALS_SQL = """
 digits AS (SELECT ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'] AS ones, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'] AS tens,
                   ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'] AS hundreds, ['', 'm', 'mm', 'mmm'] AS thousands),
 numerals AS (SELECT i::BIGINT AS i, thousands[i // 1000 + 1] || hundreds[i // 100 % 10 + 1] || tens[i // 10 % 10 + 1] || ones[i % 10 + 1] AS roman FROM digits, (SELECT unnest(range(1, 4000)) AS i))"""


@query("gld11_roman", f"WITH {NUMERALS_SQL} SELECT doc_id, roman, i AS back FROM documents JOIN numerals ON i = length(text) % 3999 + 1")
def gld11(spark, sf):
    """Of each document, the length of its text as a numeral."""
    number_ = F.length("text") % 3999 + 1
    rows = documents(spark, sf).select(F.col("document_id").alias("doc_id"), T.int_to_roman(number_).alias("roman"))
    return rows.withColumn("back", T.roman_to_int(F.col("roman")).cast("bigint"))


CLAUSE_CHUNKS_SQL = rf"""
WITH {LINES_SQL},
 titled AS (SELECT *, substring(regexp_replace(regexp_replace(says || line, '^[\s:–—-]+|[\s:–—-]+$', '', 'g'), '\s+', ' ', 'g'), 1, 60) AS title, says || line AS body FROM ended),
 named AS (SELECT *, rtrim(identifier || ' ' || replace(title, '>', ' ')) AS label FROM titled)
SELECT c.document_id, c.i AS chunk_index, c.start AS char_start, c.start + length(regexp_replace(c.head || c.body, '\s+$', '')) AS char_end,
       coalesce(p.label || ' > ', '') || c.label AS section_hierarchy,
       CASE WHEN regexp_matches(c.body, '(?i)\bterm\b') AND EXISTS (FROM ended e WHERE e.document_id = c.document_id AND e.i = 1) THEN 'Term' ELSE '' END AS terms,
       CASE WHEN c.i % 3 <> 1 THEN (c.i // 3 + 1)::VARCHAR ELSE '' END AS targets
FROM named c LEFT JOIN named p ON p.document_id = c.document_id AND p.identifier = c.parent"""


@query("chk6_clause_metadata", CLAUSE_CHUNKS_SQL)
def chk6_metadata(spark, sf):
    """Numbered documents cut at each of their clauses: section paths, terms used and targets of references."""
    rows = clause_aware.clause_aware(numbered(spark, sf), 1, 1 << 30, "uk")
    targets = F.array_join(F.transform("cross_references", lambda r: r["target"]), ",")
    return rows.select("document_id", "chunk_index", "char_start", "char_end", "section_hierarchy", F.array_join("defined_terms", ",").alias("terms"), targets.alias("targets"))


#: What an identifier may begin with, and its normal form.
WORDS = [("Clause ", ""), ("  PARAGRAPH  ", ""), ("SECTION ", "section_"), ("Article\t", "article_"), ("schedule ", "schedule_"), ("", "")]


def identifiers(spark, sf):
    """A word, a number of the document (every second one Roman), perhaps a letter and a stop: document_id, k, raw."""
    d = F.col("document_id")
    number = F.when(d % 2 == 0, F.upper(T.int_to_roman(d % 3999 + 1))).otherwise(F.concat((d % 90).cast("string"), F.lit("."), (d % 7).cast("string")))
    rows = documents(spark, sf).select("document_id", F.posexplode(F.array(*[F.lit(w) for w, _ in WORDS])).alias("k", "word"))
    letter, stop = F.when(d % 3 == 0, "(b)").otherwise(""), F.when(d % 5 == 0, "..").otherwise("")
    return rows.select("document_id", F.col("k").cast("bigint").alias("k"), "word", number.alias("number"), letter.alias("letter"), F.concat("word", number, letter, stop).alias("raw"))


IDENTIFIERS_SQL = "ids AS (SELECT doc_id AS document_id, k::BIGINT AS k, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 3999 + 1)::VARCHAR ELSE (doc_id % 90) || '.' || (doc_id % 7) END AS number, CASE WHEN doc_id % 3 = 0 THEN '(b)' ELSE '' END AS letter FROM documents, (SELECT unnest(range(0, 6)) AS k))"


#: Before a stop a numeral isn't read.
@query("txt9_normalize_identifier", f"WITH {IDENTIFIERS_SQL}, {NUMERALS_SQL} SELECT document_id, k, {[n for _, n in WORDS]}[k + 1] || CASE WHEN document_id % 10 = 0 THEN roman ELSE number END || letter AS normal FROM ids JOIN numerals ON i = document_id % 3999 + 1")
def txt9(spark, sf):
    return identifiers(spark, sf).select("document_id", "k", I.normalize_identifier(F.col("raw")).alias("normal"))


@query("txt10_claimed_identifier", f"WITH {IDENTIFIERS_SQL} SELECT document_id, k, CASE WHEN k < 2 THEN NULL WHEN document_id % 4 = 0 THEN '7' || '(c)' WHEN document_id % 4 = 1 THEN ['', '', 'SECTION ', 'Article ', 'schedule ', ''][k + 1] || number || letter || '(d)' ELSE ['', '', 'SECTION ', 'Article ', 'schedule ', ''][k + 1] || number || letter END AS claim FROM ids")
def txt10(spark, sf):
    """Breadcrumbs: a later number takes the place of an earlier one, a lettered item is added to it."""
    d, raw = F.col("document_id"), F.concat(F.trim(F.translate("word", "\t", " ")), F.when(F.col("word") != "", " ").otherwise(""), "number", "letter")
    path = F.when(F.col("k") < 2, "Recitals > no number").when(d % 4 == 0, F.concat(raw, F.lit(" - Fees > 7 Rates > (c) late"))).when(d % 4 == 1, F.concat(F.lit("4 Scope > "), raw, F.lit(" Terms > (d)"))).otherwise(F.concat(raw, F.lit(" - Supplies > general")))
    return identifiers(spark, sf).select("document_id", "k", I.claimed_identifier(path).alias("claim"))


def claims(spark, sf):
    """Chunks of whole clauses: most claim their clause in a breadcrumb (each fifth another one, each seventh none) and emit
    the clause that they refer to (each seventh another one)."""
    found = extract.extracted(numbered(spark, sf))
    clauses = extract.clause_table(found).where("level < 3")
    i = F.row_number().over(Window.partitionBy("document_id").orderBy("g_start")) - 1
    rows = clauses.withColumn("i", i)
    told = F.when(F.col("i") % 7 != 3, F.concat(F.when(F.col("i") % 5 == 4, "9999").otherwise(F.col("identifier")), F.lit(" - heading")))
    sent = F.array(F.struct(F.when(F.col("i") % 7 == 6, "9999").otherwise(F.coalesce("parent", "identifier")).alias("target")))
    chunks = rows.select(F.lit("clauses").alias("strategy"), "document_id", F.col("i").alias("chunk_index"), F.col("g_start").alias("char_start"), F.col("g_end").alias("char_end"), told.alias("section_hierarchy"), sent.alias("cross_references"))
    return found, clauses, chunks


@query("sm4_headings", f"WITH {LINES_SQL}, c AS (SELECT document_id, i % 7 <> 3 AS claims, i % 7 <> 3 AND i % 5 <> 4 AS hit, stop - start >= 50 AS reached FROM ended) SELECT 'clauses' AS strategy, document_id, round(CASE WHEN count(*) FILTER (WHERE reached) > 0 THEN count(*) FILTER (WHERE hit AND reached) / count(*) FILTER (WHERE reached) ELSE 1 END, 6) AS heading_recall, round(count(*) FILTER (WHERE hit) / count(*) FILTER (WHERE claims), 6) AS heading_precision, count(*) FILTER (WHERE reached) AS n_gold_headings FROM c GROUP BY 2")
def sm4(spark, sf):
    _, clauses, chunks = claims(spark, sf)
    rows = S.headings(chunks, clauses)
    return rows.select("strategy", "document_id", number("heading_recall").alias("heading_recall"), number("heading_precision").alias("heading_precision"), "n_gold_headings")


@query("sm5_definition_attachment", f"WITH {LINES_SQL}, u AS (SELECT document_id, i // 6 AS g, bool_or(i <> 1 AND regexp_matches(says || line, '(?i)\\bterm\\b')) AS used FROM ended GROUP BY ALL) SELECT 'six' AS strategy, document_id, count(*) FILTER (WHERE used AND (SELECT count(*) FROM ended e WHERE e.document_id = u.document_id) > 1) AS n_definition_uses, round(CASE WHEN count(*) FILTER (WHERE used AND (SELECT count(*) FROM ended e WHERE e.document_id = u.document_id) > 1) > 0 THEN count(*) FILTER (WHERE used AND g = 0 AND (SELECT count(*) FROM ended e WHERE e.document_id = u.document_id) > 1) / count(*) FILTER (WHERE used AND (SELECT count(*) FROM ended e WHERE e.document_id = u.document_id) > 1) ELSE 1 END, 6) AS definition_attachment FROM u GROUP BY 2")
def sm5(spark, sf):
    """Chunks of six clauses each; the first one has the definition."""
    docs = numbered(spark, sf)
    _, _, chunks = claims(spark, sf)
    six = chunks.groupBy(F.lit("six").alias("strategy"), "document_id", F.floor(F.col("chunk_index") / 6).alias("chunk_index")).agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    first = extract.term_table(docs).where("term = 'Term'").groupBy("document_id", "term").agg(F.min(F.struct("definition_start", "definition_end")).alias("d")).select("document_id", "term", "d.*")
    return S.definition_attachment(six, docs, first).withColumn("definition_attachment", number("definition_attachment"))


ALL_DEFINITIONS_SQL = rf"""
WITH {LINES_SQL},
 own AS (SELECT document_id, i, i // 6 AS g, regexp_matches(says || line, '(?i)\bterm\b') AS used FROM ended),
 held AS (SELECT document_id, g, count(*) FILTER (WHERE used) AS n FROM own GROUP BY ALL),
 pairs AS (SELECT document_id, h.g = d.g AS near, h.n - (h.g = d.g)::INT > 0 AS used
           FROM held h JOIN own d USING (document_id) WHERE d.i % 3 = 1)
SELECT 'six' AS strategy, document_id, coalesce(uses, 0) AS n_definition_uses, CASE WHEN uses > 0 THEN round(with_ / uses, 6) ELSE 1 END AS definition_attachment
FROM (SELECT DISTINCT document_id FROM own) LEFT JOIN
     (SELECT document_id, count(*) FILTER (WHERE used) AS uses, count(*) FILTER (WHERE used AND near) AS with_ FROM pairs GROUP BY 1) USING (document_id)"""


@query("sm5_all_definitions", ALL_DEFINITIONS_SQL)
def sm5_all(spark, sf):
    """Chunks of six clauses each, and all definitions of a document: each third clause has one."""
    docs = numbered(spark, sf)
    _, _, chunks = claims(spark, sf)
    six = chunks.groupBy(F.lit("six").alias("strategy"), "document_id", F.floor(F.col("chunk_index") / 6).alias("chunk_index")).agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    rows = S.definition_attachment(six, docs, extract.term_table(docs).where("term = 'Term'"))
    return rows.withColumn("definition_attachment", number("definition_attachment"))


@query("sm6_cross_references", f"WITH {LINES_SQL} SELECT 'clauses' AS strategy, document_id, round(count(*) FILTER (WHERE i % 3 <> 1 AND i % 7 <> 6) / count(*) FILTER (WHERE i % 3 <> 1), 6) AS xref_recall, round(count(*) FILTER (WHERE i % 3 <> 1 AND i % 7 <> 6) / count(*), 6) AS xref_precision, count(*) FILTER (WHERE i % 3 <> 1) AS n_gold_cross_refs FROM gold GROUP BY 2")
def sm6(spark, sf):
    found, _, chunks = claims(spark, sf)
    rows = S.cross_references(chunks, extract.reference_table(found).where("kind = 'internal_clause'"))
    return rows.select("strategy", "document_id", number("xref_recall").alias("xref_recall"), number("xref_precision").alias("xref_precision"), "n_gold_cross_refs")


@query("gld10_headings", f"WITH {LINES_SQL} SELECT document_id, identifier, substring(regexp_replace(regexp_replace(says || line, '^[\\s:–—-]+|[\\s:–—-]+$', '', 'g'), '\\s+', ' ', 'g'), 1, 120) AS heading FROM ended")
def gld10(spark, sf):
    rows = extract.clause_table(extract.extracted(numbered(spark, sf))).where("level < 3")
    return rows.select("document_id", "identifier", "heading")


@query("gld12_drift", f"WITH {LINES_SQL} SELECT document_id, identifier, 'fresh' AS side FROM ended WHERE i % 4 < 2 UNION ALL SELECT document_id, identifier, 'committed' FROM ended WHERE i % 4 = 1")
def gld12(spark, sf):
    """Against a committed extraction that lacks each fourth clause and has the one after it elsewhere."""
    fresh = claims(spark, sf)[1].select("document_id", "identifier", "g_start")
    i = F.row_number().over(Window.partitionBy("document_id").orderBy("g_start")) - 1
    committed = fresh.withColumn("i", i).where("i % 4 > 0").withColumn("g_start", F.col("g_start") + (F.col("i") % 4 == 1).cast("int")).drop("i")
    return extract.drift(fresh, committed).select("document_id", "identifier", "side")


@query("agg21_profile_comparison", f"""WITH {LINES_SQL}, n AS (SELECT doc_id, (SELECT count(*) FROM gold g WHERE g.document_id = doc_id AND i % 3 = 0) AS tops, (SELECT count(*) FROM gold g WHERE g.document_id = doc_id) AS nodes FROM documents),
 each AS (SELECT 'uk' AS profile, * FROM n UNION ALL SELECT 'us', doc_id, 0, 0 FROM n)
SELECT profile, count(*) FILTER (WHERE tops >= 3) AS enough_top, count(*) FILTER (WHERE nodes >= 3) AS enough_any, count(*) FILTER (WHERE nodes = 1) AS single, round(avg(nodes), 6) AS mean_nodes, median(nodes)::DOUBLE AS median_nodes FROM each GROUP BY 1""")
def agg21_profiles(spark, sf):
    """Documents numbered in one style, read in two."""
    rows = compare_profiles(numbered(spark, sf), 3, ("uk", "us"))
    return rows.withColumn("mean_nodes", number("mean_nodes"))


@query("lg_legacy_row")
def lg(spark, sf):
    return legacy.legacy_row_in_place(numbered(spark, sf), {name: chunkers.texts_of(name) for name in ("fixed_size", "sentence_split")})
