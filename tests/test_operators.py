"""Operators on tiny tables with values worked out by hand."""

import itertools
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.functions import identifiers as I, text as T
from spanlab.functions.numbers import poisoned_mean, safe_ratio, size_variation
from spanlab.operators import chunkers, classification as C, evidence as E, extract, lexical, locate, retrieval as R, spans, stats as ST, structural as S, validate, vector as V
from spanlab.sources import config, results


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


# Text


def test_sanitized(spark):
    docs = frame(spark, [("﻿a\r\nb\rc é",), (None,)], "t string")
    assert [r[0] for r in docs.select(T.sanitized(F.col("t"))).collect()] == ["a\nb\nc é", None]


def test_tokens_and_roman(spark):
    r = frame(spark, [("Straße, x_1 Ünï 2",)], "t string").select(T.word_tokens(F.col("t")).alias("w"), T.token_count(F.col("t")).alias("n")).first()
    assert r.w == ["strasse", "x_1", "ünï", "2"] and r.n == 4
    nums = frame(spark, [("xiv",), ("mcmxc",), ("clause",), ("",)], "t string").select(T.roman_to_int(F.col("t"))).collect()
    assert [n[0] for n in nums] == [14, 1990, None, None]


def test_identifiers(spark):
    cases = {"Clause 12.3": "12.3", "Section  4.02.": "section_4.02", "ARTICLE VIII": "article_8", "viii(a)": "8(a)", "paragraph 3": "3", "(a)": "(a)", "schedule 1": "schedule_1"}
    got = frame(spark, [(k,) for k in cases], "t string").select("t", I.normalize_identifier(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases
    paths = {"2 - Services > 2.5 - The Client shall: > (a) - provide": "2.5(a)", "Section 4.02 - Payment": "Section 4.02", "preamble": None, "1 - A > ARTICLE IV - Fees": "ARTICLE 4"}
    got = frame(spark, [(k,) for k in paths], "t string").select("t", I.claimed_identifier(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == paths


# Chunkers


def docs(spark, *texts):
    return frame(spark, list(enumerate(texts)), "document_id int, text string")


def spans_of(df):
    return [(r.document_id, r.char_start, r.char_end) for r in df.orderBy("document_id", "chunk_index").collect()]


def test_fixed_size(spark):
    got = chunkers.fixed_size(docs(spark, "abcdefg", "", "ab    cd", "😀b😀"), 3)
    assert spans_of(got) == [(0, 0, 3), (0, 3, 6), (0, 6, 7), (2, 0, 3), (2, 6, 8), (3, 0, 3)]  # white space alone is dropped
    with pytest.raises(ValueError):
        chunkers.fixed_size(docs(spark, "a"), 3, 1)


def slow_windows(text, window, overlap):
    import re

    found = [m.span() for m in re.finditer(r"\S+", text)]
    out = []
    for i in itertools.count(0, window - overlap):
        own = found[i : i + window]
        if not own:
            break
        out.append((own[0][0], own[-1][1]))
        if i + window >= len(found):
            break
    return out


@pytest.mark.parametrize(("window", "overlap"), [(4, 1), (3, 0), (64, 8)])
def test_token_window(spark, window, overlap):
    texts = ["", "   ", " a bb  ccc\td\n\neee f g  ", " ".join("xyz"[: i % 3 + 1] for i in range(200)), "one"]
    got = spans_of(chunkers.token_window(docs(spark, *texts), window, overlap))
    assert got == [(i, *s) for i, t in enumerate(texts) for s in slow_windows(t, window, overlap)]


def test_sentence_chunkers(spark):
    text = "First one. Second is here! Third? no capital. Fourth.  "
    got = [r.text for r in chunkers.sentence_split(docs(spark, text), 15).orderBy("chunk_index").collect()]
    assert got == ["First one. Second is here!", "Third? no capital.", "Fourth."]
    got = chunkers.sentence_window(docs(spark, "A b. C d? E! F", "no end", "", "  "))
    assert [(r.document_id, r.text) for r in got.orderBy("document_id", "chunk_index").collect()] == [(0, "A b. C d? E!"), (0, "E! F"), (1, "no end"), (3, "  ")]


def test_recursive_character():
    text = "aaaa bbbb\ncccc dddd\n\neeee ffff gggg"
    got = [text[a:b] for a, b in chunkers.recursive_spans(text, 10, 0, chunkers.SEPARATORS)]
    assert got == ["aaaa bbbb", "cccc dddd", "eeee ffff", "gggg"]
    assert all(b - a <= 10 for a, b in chunkers.recursive_spans("x" * 95, 10, 0, chunkers.SEPARATORS))
    long = " ".join(f"w{i}" for i in range(200))
    parts = chunkers.recursive_spans(long, 50, 10, chunkers.SEPARATORS)
    assert all(b - a <= 50 for a, b in parts) and all(p[1] > q[0] for p, q in zip(parts, parts[1:]))  # overlap


def test_clause_aware_and_registry(spark):
    text = "Intro text here.\n\n1. First clause is long enough to stand.\n\n2. Second clause is long enough too.\n"
    cut = chunkers.clause_aware(docs(spark, text), 10, 1000)
    assert [r.text for r in cut.orderBy("chunk_index").collect()] == ["Intro text here.", "1. First clause is long enough to stand.", "2. Second clause is long enough too."]
    both = chunkers.chunk(docs(spark, text), ["fixed_size", "clause_aware"], {"fixed_size": {"size": 20}})
    assert both.groupBy("strategy").count().count() == 2
    assert "20" in chunkers.strategy_parameters(spark, {"fixed_size": {"size": 20}}).where("strategy = 'fixed_size'").first().parameters
    with pytest.raises(ValueError):
        chunkers.chunk(docs(spark, text), ["unknown"])


# Localisation


def test_locate_cursor_and_fuzzy():
    text = "alpha beta alpha gamma delta"
    assert [x[:2] for x in locate.located_in(text, ["alpha", "alpha", "alpha"])] == [(0, 5), (11, 16), (0, 5)]
    start, end, covered, exact = locate.located_in(text, ["beta  alpha gamma"])[0]
    assert not exact and text[start:end] == " alpha gamma" and covered == 12
    assert locate.located_in(text, ["zzzz", "  "]) == [(None, None, 0, False)] * 2
    assert locate.sequential(text, ["alpha", "no", "beta"]) == [(0, 0, 5), (2, 6, 10)]


def test_located_in_spark(spark):
    d = docs(spark, "x y x z")
    chunks = frame(spark, [(0, "s", i, t) for i, t in enumerate(["x", "x", "z", "x"])], "document_id int, strategy string, chunk_index int, text string")
    for f in (locate.located, locate.located_exactly):
        assert [r.char_start for r in f(chunks, d).orderBy("chunk_index").collect()] == [0, 4, 6, 0]


# Spans


def test_merged_intervals_touching(spark):
    rows = frame(spark, [("a", 0, 5), ("a", 5, 8), ("a", 9, 10), ("a", 2, 3), ("b", 1, 1)], "k string, char_start int, char_end int")
    assert sorted((r.k, r.char_start, r.char_end) for r in spans.merged_intervals(rows, ["k"]).collect()) == [("a", 0, 8), ("a", 9, 10)]


def test_overlap_join_plan(spark):
    left = frame(spark, [("d", i * 10, i * 10 + 10) for i in range(50)], "document_id string, char_start int, char_end int")
    right = frame(spark, [("d", 5, 300), ("d", 7, 8)], "document_id string, g_start int, g_end int")
    plain = spans.overlap_join(left, right, 2)
    assert plain.columns == ["document_id", "char_start", "char_end", "g_start", "g_end", "overlap_chars"] and plain.count() == 30
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_top_k_has_group_limit(spark):
    q = frame(spark, [(1, "a b")], "query_id int, text string")
    c = frame(spark, [("d", 0, 3, "a b"), ("d", 4, 7, "a c"), ("e", 0, 1, "z")], "document_id string, char_start int, char_end int, text string")
    got = lexical.ranked(q, c, 2, ["document_id", "char_start", "char_end"])
    assert [(r.rank, r.document_id, r.char_start, round(r.score, 6)) for r in got.orderBy("rank").collect()] == [(1, "d", 0, 1.0), (2, "d", 4, 0.5)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_cosine_of_counts(spark):
    q = frame(spark, [(1, "a a b")], "query_id int, text string")
    c = frame(spark, [("d", 0, 3, "a b b")], "document_id string, char_start int, char_end int, text string")
    score = lexical.ranked(q, c, 1, ["document_id", "char_start", "char_end"]).first().score
    assert math.isclose(score, 4 / 5)


def test_budget_clip(spark):
    rows = frame(spark, [(1, 1, "d", 10, "one two three"), (1, 2, "d", 50, " four five"), (1, 3, "d", 90, "six")], "query_id int, rank int, document_id string, char_start int, text string")
    got = lexical.clipped(rows, 4).orderBy("rank").collect()
    assert [(r.tokens, r.char_start, r.char_end) for r in got] == [(3, 10, 23), (1, 50, 55)]


# Evidence


def test_evidence_scores(spark):
    q = frame(spark, [(1, True), (2, False), (3, True)], "query_id int, answerable boolean")
    gold = frame(spark, [(1, "d", 0, 10), (1, "d", 10, 20), (3, "d", 0, 5)], "query_id int, document_id string, g_start int, g_end int")
    sel = frame(spark, [(1, "d", 5, 15), (1, "d", 10, 20), (1, "e", 0, 20), (2, "d", 0, 5)], "query_id int, document_id string, char_start int, char_end int")
    got = {r.query_id: r for r in E.scores(q, sel, gold).collect()}
    assert (got[1].recall, got[1].precision) == (15 / 20, 15 / 40)
    assert got[2].recall is None and not got[2].abstention_correct
    assert (got[3].recall, got[3].precision, got[3].abstention_correct) == (0.0, 0.0, False)
    s = one(E.summary(E.scores(q, sel, gold).withColumn("strategy", F.lit("x")), ["strategy"]))
    assert s["answerable_n"] == 2 and s["mean_recall"] == 0.375 and s["abstention_accuracy"] == 0.0
    empty = one(E.summary(E.scores(q.where("query_id = 2"), sel, gold).withColumn("strategy", F.lit("x")), ["strategy"]))
    assert empty["mean_recall"] is None


# Ranking metrics

HIT = "query_id int, rank int, chunk_id string, document_id string, char_start int, char_end int"
SEC = "query_id int, document_id string, section_id string, g_start int, g_end int, grade int, ord int"


def measured(spark, hits, secs):
    q = frame(spark, [(1,)], "query_id int")
    return one(R.metrics(q, frame(spark, hits, HIT).withColumn("ord", F.col("rank")), frame(spark, secs, SEC)))


def test_rank_gap_and_duplicates(spark):
    m = measured(spark, [(1, 1, "a", "d", 0, 200), (1, 2, "a", "d", 0, 200), (1, 4, "b", "d", 500, 700)], [(1, "d", "s", 0, 150, 3, 0)])
    assert m["precision_at_1"] == 1.0 and m["precision_at_3"] == 1 / 2 and m["precision_at_5"] == 1 / 4  # the deepest rank counts
    assert m["recall_at_1"] == 1.0 and m["mrr"] == 1.0 and m["ndcg_at_10"] == 1.0


def test_empty_and_malformed_gold(spark):
    hits = [(1, 1, "a", "d", 0, 200)]
    assert measured(spark, hits, [])["recall_at_10"] == 1.0
    bad = measured(spark, hits, [(1, "d", "s", 50, 50, 2, 0)])
    assert bad["recall_at_10"] == 0.0 and bad["ndcg_at_10"] == 0.0
    none = measured(spark, [], [(1, "d", "s", 0, 150, 1, 0)])
    assert none["precision_at_5"] == 0.0 and none["drm"] == 0.0 and none["recall_at_5"] == 0.0


def test_document_mismatch(spark):
    m = measured(spark, [(1, r, str(r), "x" if r < 4 else "d", 0, 200) for r in range(1, 8)], [(1, "d", "s", 0, 150, 1, 0)])
    assert m["drm"] == 0.3 and m["drm_hit"] and m["mrr"] == 0.25


def test_short_sections_need_half(spark):
    secs = [(1, "d", "s", 0, 40, 1, 0)]
    assert measured(spark, [(1, 1, "a", "d", 0, 19)], secs)["recall_at_1"] == 0.0
    assert measured(spark, [(1, 1, "a", "d", 0, 20)], secs)["recall_at_1"] == 1.0
    assert measured(spark, [(1, 1, "a", "d", 100, 199)], [(1, "d", "s", 100, 400, 1, 0)])["recall_at_1"] == 0.0


def test_assignment_beats_greedy(spark):
    # Rank 1 reaches both sections, rank 2 only the better one: greedy would waste it.
    secs = [(1, "d", "low", 0, 100, 1, 0), (1, "d", "high", 100, 200, 3, 1)]
    m = measured(spark, [(1, 1, "a", "d", 0, 200), (1, 2, "b", "d", 100, 200)], secs)
    best = max(7 / 1 + 0, 1 / 1 + 7 / math.log2(3))
    assert math.isclose(m["ndcg_at_10"], best / (7 + 1 / math.log2(3)))


def test_large_assignment_equals_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(40):
        w = {(r, c): rng.choice([0.0, 1.0, 3.0, 7.0]) / math.log2(r + 1) for r in range(1, 6) for c in range(4) if rng.random() < 0.7}
        brute = max(sum(w.get((r, c), 0.0) for r, c in zip(p, range(4))) for p in itertools.permutations(range(1, 6), 4))
        assert math.isclose(R.best_assignment(w), brute, abs_tol=1e-12)


def test_more_sections_than_states(spark):
    secs = [(1, "d", f"s{i}", i * 100, i * 100 + 100, 1 + i % 3, i) for i in range(12)]
    m = measured(spark, [(1, r, str(r), "d", (r - 1) * 100, r * 100) for r in range(1, 11)], secs)
    assert 0 < m["ndcg_at_10"] <= 1


# Structural metrics


def test_structural_row(spark):
    clauses = frame(spark, [("d", "1", None, 0, 10, True, False, 60), ("d", "1.1", "1", 10, 35, False, True, 35), ("d", "1.2", "1", 35, 60, False, True, 60), ("d", "2", None, 60, 160, True, True, 160)], "document_id string, identifier string, parent string, g_start int, g_end int, is_top_level boolean, is_leaf boolean, subtree_end int")
    chunks = frame(spark, [("x", "d", 0, 0, 60, 60), ("x", "d", 1, 60, 130, 70), ("x", "d", 2, 0, 160, 160), ("x", "d", 3, None, None, 10), ("y", "d", 0, 0, 20, 20)], "strategy string, document_id string, chunk_index int, char_start int, char_end int, char_count int")
    got = {r.strategy: r for r in S.structural_row(chunks, clauses).collect()}
    assert got["x"].clause_fragmentation == 0.0 and got["y"].clause_fragmentation == 1.0
    assert got["x"].top_level_over_merge == 1 / 3 and got["x"].sub_clause_grouping == 2 / 3
    assert got["x"].localization_rate == 0.75 and got["y"].size_cv == 0.0


def test_number_conventions(spark):
    rows = frame(spark, [("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    got = {r.k: r for r in rows.groupBy("k").agg(poisoned_mean(F.col("x")).alias("p"), F.avg("x").alias("s"), size_variation(F.col("x")).alias("cv")).collect()}
    assert got["a"].p is None and got["a"].s == 1.0 and got["a"].cv == 0.0 and math.isclose(got["b"].cv, 1 / 3)
    assert frame(spark, [(1, 0)], "a int, b int").select(safe_ratio(F.col("a"), F.col("b"), 1.0)).first()[0] == 1.0


# Statistics


def test_holm(spark):
    rows = frame(spark, [(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.04)], "i int, p double")
    assert [round(r.p_holm, 6) for r in ST.holm(rows, "p").orderBy("i").collect()] == [0.04, 0.06, 0.06, 0.06]


def test_p_values_of_tables():
    for t, df, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (2.575829, 1e7, 0.01), (3.169273, 10, 0.01)):
        assert math.isclose(ST.t_p_value(t, df), p, rel_tol=1e-5)
    assert ST.t_p_value(float("nan"), 3) == 1.0 and ST.t_p_value(float("inf"), 3) == 0.0
    assert ST.wilcoxon_p_value(5, 15.0, 0.0) == 0.0625 and ST.wilcoxon_p_value(0, 0.0, 0.0) == 1.0
    assert ST.wilcoxon_p_value(3, 4.0, 0.0) == 0.75


def test_effect_sizes(spark):
    rows = frame(spark, [("z", 1, 0.0), ("z", 2, 0.0), ("c", 1, 0.5), ("c", 2, 0.5), ("m", 1, 1.0), ("m", 2, -2.0), ("m", 3, 0.0), ("s", 1, 1.0)], "k string, query_id int, diff double")
    got = {r.k: r for r in rows.groupBy("k").agg(ST.cohens_d(F.col("diff")).alias("d"), ST.t_statistic(F.col("diff")).alias("t")).collect()}
    assert got["z"].d == 0.0 and got["z"].t == 0.0 and got["c"].d == math.inf
    ranks = {r.k: r for r in ST.signed_ranks(rows, ["k"]).collect()}
    assert ranks["m"].rank_biserial == (1 - 2) / 3 and ranks["z"].rank_biserial == 0.0
    ends = {r.k: r for r in ST.bootstrap_means(rows, ["k"], resamples=50).collect()}
    assert ends["s"].low is None and ends["c"].low == ends["c"].high == 0.5


def test_bootstrap_of_any_statistic(spark):
    rows = frame(spark, [("s", i, float(i % 2)) for i in range(20)], "k string, item_id int, x double")
    same = one(ST.order_statistic_interval(rows, ["k"], "x", 40))
    got = one(ST.bootstrap_statistic(rows, ["k"], lambda r: (r["x"] * r["times"]).sum() / r["times"].sum(), ["x"], 40))
    assert math.isclose(got["low"], same["low"]) and math.isclose(got["high"], same["high"])


def test_leave_one_out(spark):
    rows = frame(spark, [("k", "a", 1.0), ("k", "a", 1.0), ("k", "b", 0.0), ("k", "c", 0.0)], "k string, document_id string, diff double")
    r = one(ST.leave_one_out(rows, ["k"]))
    assert (r["lodo_min"], r["lodo_worst"]) == (0.0, "a") and math.isclose(r["lodo_max"], 2 / 3)


def test_spearman_and_sample(spark):
    rows = frame(spark, [("u", 1.0, 2.0), ("u", 2.0, 4.0), ("u", 3.0, 9.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0)], "k string, x double, y double")
    got = {r.k: r.spearman for r in ST.spearman(rows, ["k"], "x", "y").collect()}
    assert math.isclose(got["u"], 1.0) and got["c"] == 0.0
    ids = spark.range(100)
    a = [r.id for r in ST.seeded_sample(ids, 10, 3, "id").collect()]
    assert a == sorted(a) and len(a) == 10 and a == [r.id for r in ST.seeded_sample(ids.orderBy(F.desc("id")), 10, 3, "id").collect()]
    assert ST.seeded_sample(ids, 0, 3, "id").count() == 100


# Classification


def test_classification(spark):
    rows = frame(spark, [("s", "a", "a", 0.0), ("s", "a", "b", 1.0), ("s", "b", "b", 1.5), ("s", "c", "b", 0.55)], "system string, gold string, pred string, confidence double")
    got = {r.label: r for r in C.per_class(rows, ["system"]).collect()}
    assert (got["a"].precision, got["a"].recall) == (1.0, 0.5) and got["c"].f1 == 0.0 and got["b"].predicted == 3
    assert math.isclose(one(C.macro_f1(rows, ["system"]))["macro_f1"], (2 / 3 + 0.5 + 0) / 3)
    bins = {r.bin: r for r in C.calibration(rows, ["system"]).collect()}
    assert set(bins) == {0, 5, 9} and bins[9].n == 2 and bins[9].bin_accuracy == 0.5
    assert one(C.majority(rows))["majority"] == "a"
    assert [(r.gold, r.pred, r.n) for r in C.confusion_top(rows, ["system"]).orderBy("place").collect()] == [("a", "b", 1), ("c", "b", 1)]


# Vectors


def test_vectors(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])], "vec_id int, vec array<float>")
    q = frame(spark, [(9, [1.0, 0.0])], "query_id int, q array<float>")
    assert [(r.vec_id, r.score) for r in V.top_k(q, v, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    texts = frame(spark, [(1, "a b"), (2, "a b"), (3, "")], "owner_id int, text string")
    got = {r.owner_id: r.vec for r in V.embedded(texts).collect()}
    assert got[1] == got[2] and math.isclose(sum(x * x for x in got[1]), 1.0, rel_tol=1e-6) and set(got[3]) == {0.0}
    assert validate.vector_violations(v, 2).count() == 1


# Extraction

EU = "(1) First recital.\n\n(2) Second recital.\n\nCHAPTER I\nGeneral provisions\n\nArticle 1\nScope\n\n1. It applies, see Article 2.\n\n2. It does not.\n\nArticle 2\nTerms\n\n\"Data\" means facts.\n"
US = "ARTICLE I\nDefinitions\n\nSection 1.01 Terms. In this deed.\n\n(a) one\n(b) two\n\nSection 1.02 More. See Sections 1.01 and 1.03 and Article I.\n\nEXHIBIT A\n\nSection 9.99 Not this. No.\n"
UK = "1. DEFINITIONS\n\n1.1 In this deed:\n\n(a) apples; and\n(b) pears, see clause 2.\n\n2. FEES\n\nSCHEDULE 1 Services\n\n1. Work\n"


def test_clauses_by_style():
    names = lambda t, s: [(c["identifier"], c["parent"]) for c in extract.clauses(t, s)]
    assert names(EU, "eu_regulation") == [("recital_1", None), ("recital_2", None), ("chapter_1", None), ("article_1", "chapter_1"), ("article_1_1", "article_1"), ("article_1_2", "article_1"), ("article_2", "chapter_1")]
    assert names(US, "us_article_section") == [("article_1", None), ("section_1.01", "article_1"), ("section_1.01(a)", "section_1.01"), ("section_1.01(b)", "section_1.01"), ("section_1.02", "article_1")]
    assert names(UK, "uk_decimal") == [("1", None), ("1.1", "1"), ("1.1(a)", "1.1"), ("1.1(b)", "1.1"), ("2", None), ("schedule_1", None), ("schedule_1.1", "schedule_1")]
    assert [c["heading"] for c in extract.clauses(US, "us_article_section")][:2] == ["Definitions", "Terms"]


def test_terms_references_and_table(spark):
    found = extract.extracted(frame(spark, [("eu", EU, "eu_regulation"), ("us", US, "us_article_section")], "document_id string, text string, numbering_style string"))
    term = one(extract.term_table(found))
    assert term["term"] == "Data" and EU[term["definition_start"] : term["definition_end"]] == '"Data" means facts.\n'
    refs = {(r.document_id, r.raw_text): r.target for r in extract.reference_table(found).collect()}
    assert refs == {("eu", "Article 2"): "article_2", ("us", "1.01"): "section_1.01", ("us", "1.03"): None, ("us", "Article I"): "article_1", ("us", "9.99"): None}  # after the exhibit there are references, but no clauses
    table = extract.clause_table(found)
    assert table.where("document_id = 'eu'").agg(F.max("g_end")).first()[0] == len(EU)
    assert extract.drift(table, table).count() == 0


# Validators


def test_clause_rules(spark):
    schema = "document_id string, n_chars int, identifier string, level int, parent string, g_start int, g_end int, is_top_level boolean"
    good = [("d", 50, "1", 1, None, 0, 10, True), ("d", 50, "1.1", 2, "1", 10, 50, False)]
    assert validate.clause_violations(frame(spark, good, schema)).count() == 0
    for bad in [("d", 50, "2", 1, None, 40, 60, True), ("d", 50, "1", 1, None, 50, 50, True), ("d", 50, "x", 2, "9", 50, 50, False), ("d", 50, "y", 1, None, 5, 9, False)]:
        found = validate.clause_violations(frame(spark, [*good, bad], schema))
        with pytest.raises(ValueError, match="d: "):
            validate.raise_if_any(found)


# Sinks and configuration


def test_reports(tmp_path):
    report = results.hashed_report({"b": {3, 1}, "a": float("inf")})
    assert results.verified(report) and not results.verified(report | {"a": 1})
    assert results.canonical({"b": 1, "a": {2, 1}}) == '{"a":[1,2],"b":1}'
    doc = "x\n<!-- t:start -->\nold\n<!-- t:end -->\ny"
    new = results.replaced(doc, "t", results.markdown_table([{"a": 0.12345, "b": None}], ["a", "b"]))
    assert "| 0.123 | n/a |" in new and results.stale(doc, "t", "new") and not results.stale(new, "t", results.markdown_table([{"a": 0.12345, "b": None}], ["a", "b"]))
    assert "<td>&lt;b&gt;</td>" in results.html_report("t", {"x": [{"a": "<b>"}]})


def test_results_round_trip(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"strategy": "a", "clause_fragmentation": 0.5}\n{"strategy": "b", "legacy_fragmentation": 0.25}\nnot json\n')
    now, old = results.read_structural(spark, str(path))
    assert now.select("strategy").collect() == [("a",)] and old.select("strategy").collect() == [("b",)]
    results.export_json({"x": frame(spark, [(1, 2.0)], "a int, b double")}, str(tmp_path / "o.json"), seed=1)
    assert json.loads((tmp_path / "o.json").read_text()) == {"seed": 1, "x": [{"a": 1, "b": 2.0}]}
    assert results.manifest(spark, {"a": 1}, 3).first().seed == 3


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("benchmark:\n  top_k: 7\n  seed: 1\n")
    got = config.load(str(path), env={"SPANLAB_SEED": "2", "SPANLAB_STRATEGIES": "fixed_size, rcts_512"}, depth=3)
    assert (got.top_k, got.seed, got.depth, got.strategies) == (7, 2, 3, ("fixed_size", "rcts_512"))
    for wrong in ({"top_k": 0}, {"nothing": 1}, {"strategies": ["x"]}, {"top_k": True}):
        with pytest.raises(config.ConfigError):
            config.load(env={}, **wrong)


def test_incremental_scoring(spark, tmp_path):
    from spanlab.streaming.incremental import score_arrivals

    docs(spark, "a b c. " * 50, "d").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id int, text string").parquet(str(tmp_path / "in"))
    q = score_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["fixed_size"])
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


# Rules of localisation, headings and references


def plain_located(text, chunks):
    """Longest ends by trying every length."""
    out, cursor = [], 0

    def find(piece):
        at = text.find(piece, cursor)
        return at if at >= 0 else text.find(piece)

    for c in chunks:
        if not c.strip():
            out.append((None, None, 0, False))
            cursor = 0
            continue
        if c in text:
            spans_ = [(find(c), len(c))]
        else:
            ends = [next((p for n in range(len(c), 0, -1) if 2 * n >= len(c) and (p := cut(n)) in text), None) for cut in (lambda n: c[len(c) - n :], lambda n: c[:n])]
            spans_ = [(find(p), len(p)) for p in ends if p]
        if not spans_:
            out.append((None, None, 0, False))
            cursor = 0
            continue
        if len(spans_) == 2 and max(spans_)[0] - min(a + n for a, n in spans_) > 2 * len(c):
            spans_ = [max(spans_, key=lambda x: x[1])]  # the first, the suffix, at a tie
        out.append((min(a for a, _ in spans_), max(a + n for a, n in spans_), max(n for _, n in spans_), c in text))
        cursor = max(cursor, out[-1][1])
    return out


def test_fuzzy_places_against_all_lengths():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab c"), 60))
        chunks = []
        for _ in range(6):
            a, n = rng.integers(0, 50, 2)
            piece = text[a : a + n % 12 + 1]
            chunks.append(piece if rng.random() < 0.4 else piece + "x" * int(rng.integers(0, 4)) + text[n : n + int(rng.integers(0, 9))])
        assert locate.located_in(text, chunks) == plain_located(text, chunks)


def test_fuzzy_covered_is_the_longer_end():
    text = "one two three four. five six seven eight."
    start, end, covered, exact = locate.located_in(text, ["one two three four. xx five six seven eight."])[0]
    assert (start, end, covered, exact) == (19, 41, 22, False)  # " five six seven eight."
    far = "head words here" + " " * 200 + "tail words there"
    assert locate.located_in(far, ["head words here|tail words there"])[0] == (215, 231, 16, False)
    again = "alpha beta. gamma. alpha beta. delta."
    assert [x[:2] for x in locate.located_in(again, ["gamma.", "alpha beta. zeta"])] == [(12, 18), (19, 31)]  # from the cursor first


def test_references_of_paragraphs_and_schedules(spark):
    text = "1. Scope\n\n1.1 See paragraph 2 of Schedule 1 and clauses 1, 1.1 and 9.\n\nSCHEDULE 1 Fees\n\n1. Rates, see paragraph 2 below.\n\n2. Dates, see paragraphs 7 above and Schedule 3 and the Data Protection Act 2018.\n\nSCHEDULE 2 More\n\n1. As paragraph 1 above.\n"
    found = extract.extracted(frame(spark, [("uk", text, "uk_decimal")], "document_id string, text string, numbering_style string"))
    got = sorted((r.ref_start, r.raw_text, r.target, r.kind) for r in extract.reference_table(found).collect())
    place = lambda raw, nth=0: [m.start() for m in re.finditer(re.escape(raw), text)][nth]
    want = [("paragraph 2 of Schedule 1", "schedule_1.2", "internal_schedule", 0), ("Schedule 1", "schedule_1", "internal_schedule", 0), ("paragraph 2 below", "schedule_1.2", "internal_schedule", 0)]
    want += [("paragraphs 7 above", None, "internal_schedule", 0), ("Schedule 3", None, "internal_schedule", 0), ("paragraph 1 above", "schedule_2.1", "internal_schedule", 0), ("the Data Protection Act 2018", None, "external_statute", 0)]
    listed = text.index("clauses 1")
    assert got == sorted([(place(raw, n), raw, target, kind) for raw, target, kind, n in want] + [(listed + 8, "1", "1", "internal_clause"), (listed + 11, "1.1", "1.1", "internal_clause"), (listed + 19, "9", None, "internal_clause")])


def test_definition_ends_at_paragraph_or_next_definition(spark):
    text = "\"One\" means a. \"Two\" shall mean b.\nstill b\n \t\n'Three' refers to c.\n\nx"
    got = {r.term: text[r.definition_start : r.definition_end] for r in extract.term_table(frame(spark, [("d", text)], "document_id string, text string")).collect()}
    assert got == {"One": '"One" means a. ', "Two": '"Two" shall mean b.\nstill b', "Three": "'Three' refers to c."}


def test_headings_that_touch_no_clause_and_no_headings(spark):
    from spanlab.operators import structural

    clauses_ = frame(spark, [("d", "1", 100, 200), ("d", "2", 200, 300)], "document_id string, identifier string, g_start long, g_end long")
    chunks = frame(spark, [("s", "d", 0, 0, 50, "9 Front"), ("s", "d", 1, 100, 190, "1 First"), ("s", "d", 2, 190, 230, "1 First"), ("t", "d", 0, 100, 300, None)], "strategy string, document_id string, chunk_index int, char_start long, char_end long, section_hierarchy string")
    got = {r.strategy: r for r in structural.headings(chunks, clauses_).collect()}
    assert (got["s"].heading_recall, got["s"].heading_precision, got["s"].n_gold_headings) == (1.0, 1.0, 1)  # the claim of the front counts not at all
    assert (got["t"].heading_recall, got["t"].heading_precision, got["t"].n_gold_headings) == (None, None, 2)


def test_models_are_resolved_by_key_and_permission():
    paid = {"costly": "COSTLY_KEY"}
    assert V.resolved_models(["hashed_64"], paid, False, {"COSTLY_KEY": "x"}) == ["hashed_64"]
    assert V.resolved_models(["costly", "hashed_64"], paid, False, {"COSTLY_KEY": "x"}) == ["hashed_64"]
    assert V.resolved_models(["hashed_64"], paid, True, {"COSTLY_KEY": "x"}) == ["hashed_64", "costly"]
    for configured, allow, env in ((["costly"], True, {}), ([], False, {}), (["unheard"], False, {})):
        with pytest.raises(V.ModelError):
            V.resolved_models(configured, paid, allow, env)
