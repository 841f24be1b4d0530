"""Statistics and classification over the driver's tables.

Paired scores are digests of (strategy, query), so any engine has the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import classification as C, stats as ST
from spanlab.plans.tables import documents, number, query, table

RESAMPLES = 10_000
STRATEGIES = ("alpha", "beta", "gamma")
SCORES_SQL = f"""
 base AS (SELECT doc_id AS query_id, source AS document_id FROM documents),
 s AS (SELECT strategy, query_id, document_id, (('0x' || substring(md5(strategy || ':' || query_id), 1, 4))::BIGINT % 20) / 20 AS mrr, (('0x' || substring(md5(strategy || '/' || query_id), 1, 4))::BIGINT % 100) / 100 AS ndcg FROM base, (VALUES ('alpha'), ('beta'), ('gamma')) t(strategy)),
 u AS (SELECT strategy, query_id, document_id, 'mrr' AS metric, mrr AS v FROM s UNION ALL SELECT strategy, query_id, document_id, 'ndcg', ndcg FROM s),
 d AS (SELECT b.strategy AS strategy_b, a.metric, a.query_id, a.document_id, a.v AS a, b.v AS b, a.v - b.v AS diff FROM u a JOIN u b USING (query_id, metric) WHERE a.strategy = 'alpha' AND b.strategy <> 'alpha')"""
BY = ["strategy_b", "metric"]
_ONE = "(xor($, $ >> 16) * 73244475 % 4294967296)"
_TWO = _ONE.replace("$", _ONE)
#: The scrambling of a whole number $ that the draws use.
SCRAMBLED = f"xor({_TWO}, {_TWO} >> 16)"


def paired(spark, sf):
    base = documents(spark, sf).select(F.col("document_id").alias("query_id"), F.col("source").alias("document_id"))
    rows = base.withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES)))).withColumn("model", F.lit("m"))
    digest = lambda sep, m: (F.conv(F.substring(F.md5(F.concat_ws(sep, "strategy", "query_id")), 1, 4), 16, 10).cast("bigint") % m) / m
    rows = rows.withColumn("mrr", digest(":", 20)).withColumn("ndcg", digest("/", 100))
    diffs = ST.paired(rows.drop("document_id"), ["alpha"], ["mrr", "ndcg"])
    return diffs.join(base, "query_id")


@query("jn9_paired_differences", f"WITH {SCORES_SQL} SELECT strategy_b, metric, query_id, round(diff, 6) AS diff FROM d")
def jn9(spark, sf):
    return paired(spark, sf).select(*BY, "query_id", number("diff").alias("diff"))


@query("st1_paired_bootstrap", f"WITH {SCORES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY strategy_b, metric ORDER BY diff) - 1 AS pick FROM d), draws AS (SELECT r, i, {SCRAMBLED.replace("$", "xor(base_r, mixed_i)")} % (SELECT count(*) FROM base) AS pick FROM (SELECT r, {SCRAMBLED.replace("$", "(r + 42 * 1000003)")} AS base_r FROM range({RESAMPLES}) t(r)), (SELECT i, {SCRAMBLED.replace("$", "(i + 1)")} AS mixed_i FROM (SELECT unnest(range((SELECT count(*) FROM base))) AS i)) v), m AS (SELECT strategy_b, metric, r, avg(diff) AS m FROM draws JOIN numbered USING (pick) GROUP BY ALL) SELECT strategy_b, metric, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY ALL")
def st1(spark, sf):
    return ST.bootstrap_means(paired(spark, sf), BY, "diff", RESAMPLES).select(*BY, number("low").alias("low"), number("high").alias("high"))


@query("st2_item_bootstrap", f"WITH {SCORES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY strategy_b, metric ORDER BY a) - 1 AS pick FROM d), draws AS (SELECT r, i, {SCRAMBLED.replace("$", "xor(base_r, mixed_i)")} % (SELECT count(*) FROM base) AS pick FROM (SELECT r, {SCRAMBLED.replace("$", "(r + 42 * 1000003)")} AS base_r FROM range({RESAMPLES}) t(r)), (SELECT i, {SCRAMBLED.replace("$", "(i + 1)")} AS mixed_i FROM (SELECT unnest(range((SELECT count(*) FROM base))) AS i)) v), m AS (SELECT strategy_b, metric, r, avg(a) AS m FROM draws JOIN numbered USING (pick) GROUP BY ALL), l AS (SELECT strategy_b, metric, list_sort(list(m)) AS ms FROM m GROUP BY ALL) SELECT strategy_b, metric, round((SELECT avg(a) FROM d WHERE d.strategy_b = l.strategy_b AND d.metric = l.metric), 6) AS point, round(ms[{int(0.025 * RESAMPLES) + 1}], 6) AS low, round(ms[{int(0.975 * RESAMPLES) + 1}], 6) AS high FROM l")
def st2(spark, sf):
    return ST.order_statistic_interval(paired(spark, sf), BY, "a", RESAMPLES).select(*BY, *[number(c).alias(c) for c in ("point", "low", "high")])


@query("st3_t_statistic", f"WITH {SCORES_SQL} SELECT strategy_b, metric, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 5) AS t FROM d GROUP BY ALL")
def st3(spark, sf):
    return paired(spark, sf).groupBy(*BY).agg(number(ST.t_statistic(F.col("diff")), 5).alias("t"))


RANKS_SQL = "r AS (SELECT *, rank() OVER (PARTITION BY strategy_b, metric ORDER BY round(abs(diff), 9)) + (count(*) OVER (PARTITION BY strategy_b, metric, round(abs(diff), 9)) - 1) / 2 AS rk FROM d WHERE round(diff, 9) <> 0)"


@query("st4_st5_signed_ranks", f"WITH {SCORES_SQL}, {RANKS_SQL}, w AS (SELECT strategy_b, metric, coalesce(sum(rk) FILTER (WHERE diff > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (WHERE diff < 0), 0) AS w_minus, count(*) AS n_nonzero FROM r GROUP BY ALL) SELECT *, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial FROM w")
def st45(spark, sf):
    out = ST.signed_ranks(paired(spark, sf).withColumn("diff", F.round("diff", 9)), BY)
    return out.withColumn("rank_biserial", number("rank_biserial")).drop("p_wilcoxon")


def simpson(integrand: str, top: str, steps: int = 4000) -> str:
    """SQL of the integral from 0 to top of a function of u."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT sum({weight} * ({integrand})) * ({top}) / {3 * steps} FROM (SELECT k, ({top}) * k / {steps} AS u FROM range({steps + 1}) t(k)))"


WILCOXON_SQL = f"""
 w AS (SELECT strategy_b, metric, count(*) AS n_nonzero, coalesce(sum(rk) FILTER (WHERE diff > 0), 0) AS w_plus FROM r GROUP BY ALL),
 ties AS (SELECT strategy_b, metric, sum(t * t * t - t)::DOUBLE AS tied FROM (SELECT strategy_b, metric, rk, count(*)::HUGEINT AS t FROM r GROUP BY ALL) GROUP BY ALL),
 z AS (SELECT strategy_b, metric, n_nonzero, w_plus, abs(w_plus - n_nonzero * (n_nonzero + 1) / 4) / sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - tied / 48) AS z FROM w JOIN ties USING (strategy_b, metric)),
 wilcoxon AS (SELECT *, 1 - 2 / sqrt(2 * pi()) * {simpson("exp(-u * u / 2)", "z.z")} AS p_wilcoxon FROM z)"""


@query("st4_wilcoxon_p", f"WITH {SCORES_SQL}, {RANKS_SQL}, {WILCOXON_SQL} SELECT strategy_b, metric, n_nonzero, w_plus, round(p_wilcoxon, 6) AS p_wilcoxon FROM wilcoxon")
def st4(spark, sf):
    out = ST.signed_ranks(paired(spark, sf).withColumn("diff", F.round("diff", 9)), BY)
    return out.select(*BY, "n_nonzero", "w_plus", number("p_wilcoxon").alias("p_wilcoxon"))


@query("st6_cohens_d", f"WITH {SCORES_SQL} SELECT strategy_b, metric, round(avg(diff) / stddev_samp(diff), 6) AS d FROM d GROUP BY ALL")
def st6(spark, sf):
    return paired(spark, sf).groupBy(*BY).agg(number(ST.cohens_d(F.col("diff"))).alias("d"))


@query("st7_holm", f"WITH {SCORES_SQL}, p AS (SELECT query_id, min(a) AS p FROM d GROUP BY 1), o AS (SELECT *, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p, query_id) + 1), 1) AS step FROM p) SELECT query_id, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, query_id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM o")
def st7(spark, sf):
    rows = paired(spark, sf).groupBy("query_id").agg(F.min("a").alias("p"))
    return ST.holm(rows, "p").select("query_id", number("p").alias("p"), number("p_holm").alias("p_holm"))


@query("st8_leave_one_document_out", f"WITH {SCORES_SQL}, w AS (SELECT strategy_b, metric, sum(diff) AS s, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT strategy_b, metric, document_id, (any_value(s) - sum(diff)) / (any_value(n) - count(*)) AS m FROM d JOIN w USING (strategy_b, metric) GROUP BY ALL HAVING any_value(n) - count(*) >= 2) SELECT strategy_b, metric, round(min(m), 6) AS lodo_min, round(max(m), 6) AS lodo_max FROM e GROUP BY ALL")
def st8(spark, sf):
    return ST.leave_one_out(paired(spark, sf), BY).select(*BY, number("lodo_min").alias("lodo_min"), number("lodo_max").alias("lodo_max"))


MATRIX_SQL = f"""
WITH {SCORES_SQL.replace("a.v - b.v AS diff", "round(a.v - b.v, 9) AS diff")}, {RANKS_SQL}, {WILCOXON_SQL},
 numbered AS (SELECT *, row_number() OVER (PARTITION BY strategy_b, metric ORDER BY diff) - 1 AS pick FROM d),
 draws AS (SELECT r, {SCRAMBLED.replace("$", "xor(base_r, mixed_i)")} % (SELECT count(*) FROM base) AS pick
           FROM (SELECT r, {SCRAMBLED.replace("$", "(r + 42 * 1000003)")} AS base_r FROM range({RESAMPLES}) t(r)), (SELECT i, {SCRAMBLED.replace("$", "(i + 1)")} AS mixed_i FROM (SELECT unnest(range((SELECT count(*) FROM base))) AS i)) v),
 means AS (SELECT strategy_b, metric, r, avg(diff) AS m FROM draws JOIN numbered USING (pick) GROUP BY ALL),
 ends AS (SELECT strategy_b, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY ALL),
 whole AS (SELECT strategy_b, metric, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(diff) AS mean_diff, sum(diff) AS s, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t, avg(diff) / stddev_samp(diff) AS cohens_d FROM d GROUP BY ALL),
 p AS (SELECT *, 1 - 2 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * {simpson("pow(1 + u * u / (w.n - 1), -w.n / 2)", "abs(w.t)")} AS p_t FROM whole w),
 steps AS (SELECT *, least(p_t * (count(*) OVER () - row_number() OVER (ORDER BY p_t) + 1), 1) AS step FROM p),
 corrected AS (SELECT *, max(step) OVER (ORDER BY p_t ROWS UNBOUNDED PRECEDING) AS p_holm FROM steps),
 without AS (SELECT strategy_b, metric, min((s - diff) / (n - 1)) AS lodo_min, max((s - diff) / (n - 1)) AS lodo_max FROM d JOIN whole USING (strategy_b, metric) GROUP BY ALL),
 sums AS (SELECT strategy_b, metric, sum(rk) FILTER (WHERE diff < 0) AS w_minus FROM r GROUP BY ALL)
SELECT 'alpha' AS strategy_a, strategy_b, metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_diff, 6) AS mean_diff, round(t, 5) AS t, round(cohens_d, 6) AS cohens_d,
       round(p_t, 6) AS p_t, round(p_holm, 6) AS p_holm, round(low, 6) AS low, round(high, 6) AS high, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial,
       round(p_wilcoxon, 6) AS p_wilcoxon, round(lodo_min, 6) AS lodo_min, round(lodo_max, 6) AS lodo_max, p_holm < 0.05 AS significant
FROM corrected JOIN ends USING (strategy_b, metric) JOIN wilcoxon USING (strategy_b, metric) JOIN without USING (strategy_b, metric) JOIN sums USING (strategy_b, metric)"""
MATRIX = ["mean_a", "mean_b", "mean_diff", "cohens_d", "p_t", "p_holm", "low", "high", "rank_biserial", "p_wilcoxon", "lodo_min", "lodo_max"]


@query("st9_comparison_matrix", MATRIX_SQL)
def st9(spark, sf):
    rows = ST.comparison_matrix(paired(spark, sf).drop("document_id").withColumn("diff", F.round("diff", 9)), RESAMPLES)
    return rows.select("strategy_a", *BY, "n", number("t", 5).alias("t"), *[number(c).alias(c) for c in MATRIX], "significant")


@query("st11_spearman", "WITH d AS (SELECT lang, length(text) AS x, length(text) % 97 AS y FROM documents), r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2 AS ry FROM d) SELECT lang, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1")
def st11(spark, sf):
    rows = documents(spark, sf).select("lang", F.length("text").alias("x"), (F.length("text") % 97).alias("y"))
    return ST.spearman(rows, ["lang"], "x", "y").withColumn("spearman", number("spearman"))


@query("st12_seeded_sample", "SELECT doc_id AS document_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def st12(spark, sf):
    return ST.seeded_sample(documents(spark, sf).select("document_id"), 50, 7, "document_id")


@query("win7_average_ranks", "SELECT doc_id AS document_id, rank() OVER (PARTITION BY lang ORDER BY length(text) % 50) + (count(*) OVER (PARTITION BY lang, length(text) % 50) - 1) / 2 AS rk FROM documents")
def win7(spark, sf):
    rows = documents(spark, sf).select("document_id", "lang", (F.length("text") % 50).alias("v"))
    return ST.average_ranks(rows, ["lang"], "v", "rk").select("document_id", "rk")


ITEMS_SQL = "items AS (SELECT doc_id AS item_id, l.toxic::VARCHAR AS gold, CASE WHEN regexp_matches(lower(text), 'idiot|stupid|moron|trash') THEN '1' ELSE '0' END AS pred, (length(text) % 1000) / 999 AS confidence FROM documents JOIN labels l USING (doc_id))"


def items(spark, sf):
    rows = documents(spark, sf).join(table(spark, sf, "labels"), F.col("document_id") == F.col("doc_id"))
    pred = F.when(F.lower("text").rlike("idiot|stupid|moron|trash"), "1").otherwise("0")
    return rows.select(F.col("document_id").alias("item_id"), F.col("toxic").cast("string").alias("gold"), pred.alias("pred"), (F.length("text") % 1000 / 999).alias("confidence"), F.lit("rule").alias("system"))


CLASS_SQL = ITEMS_SQL + ", c AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (WHERE gold = pred) AS hit FROM items GROUP BY 1), p AS (SELECT pred AS label, count(*) AS predicted FROM items GROUP BY 1), k AS (SELECT label, support, coalesce(predicted, 0) AS predicted, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS pr, hit / support AS re FROM c LEFT JOIN p USING (label)), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM k)"


@query("agg13_per_class", f"WITH {CLASS_SQL} SELECT label, support, predicted, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def agg13(spark, sf):
    return C.per_class(items(spark, sf), ["system"]).select("label", "support", "predicted", *[number(c).alias(c) for c in ("precision", "recall", "f1")])


@query("agg14_accuracy_macro_f1", f"WITH {CLASS_SQL} SELECT (SELECT round(avg((gold = pred)::INT), 6) FROM items) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def agg14(spark, sf):
    rows = items(spark, sf)
    return C.accuracy(rows, ["system"]).join(C.macro_f1(rows, ["system"]), "system").select(number("accuracy").alias("accuracy"), number("macro_f1").alias("macro_f1"))


@query("agg15_confusion_top", f"WITH {ITEMS_SQL} SELECT gold, pred, count(*) AS n FROM items WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 15")
def agg15(spark, sf):
    return C.confusion_top(items(spark, sf), ["system"]).select("gold", "pred", "n")


BINS_SQL = ITEMS_SQL + ", b AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, avg(confidence) AS mean_confidence, avg((gold = pred)::INT) AS bin_accuracy, count(*) AS n FROM items GROUP BY 1)"


@query("agg16_calibration_bins", f"WITH {BINS_SQL} SELECT bin, round(mean_confidence, 6) AS mean_confidence, round(bin_accuracy, 6) AS bin_accuracy, n FROM b")
def agg16(spark, sf):
    return C.calibration(items(spark, sf), ["system"]).select(F.col("bin").cast("bigint").alias("bin"), number("mean_confidence").alias("mean_confidence"), number("bin_accuracy").alias("bin_accuracy"), "n")


@query("agg16_calibration_error", f"WITH {BINS_SQL}, l AS (SELECT *, bin_accuracy < lag(bin_accuracy) OVER (ORDER BY bin) AS down FROM b) SELECT round(sum(n * abs(mean_confidence - bin_accuracy)) / sum(n), 6) AS ece, NOT bool_or(coalesce(down, false)) AS monotone FROM l")
def agg16_error(spark, sf):
    return C.calibration_error(items(spark, sf), ["system"]).select(number("ece").alias("ece"), "monotone")


@query("agg17_majority_class", f"WITH {ITEMS_SQL} SELECT gold AS majority FROM items GROUP BY 1 ORDER BY count(*) DESC, gold LIMIT 1")
def agg17(spark, sf):
    return C.majority(items(spark, sf))


@query("flt7_out_of_scope", "SELECT lang <> 'es' AS kept, count(*) AS n FROM documents GROUP BY 1")
def flt7(spark, sf):
    targets = spark.createDataFrame([("en", "a"), ("de", "a"), ("fr", "b"), ("es", C.OUT_OF_SCOPE)], "source_label string, target string")
    rows = C.mapped(documents(spark, sf).withColumnRenamed("lang", "source_label"), targets)
    return rows.groupBy((F.col("target") != C.OUT_OF_SCOPE).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query("flt7_unmapped", "SELECT source AS source_label, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' GROUP BY 1 HAVING count(*) > 5) GROUP BY 1")
def flt7_unmapped(spark, sf):
    """Sources without a target, where those with more than five Spanish documents have one."""
    docs = documents(spark, sf)
    known = docs.where("lang = 'es'").groupBy("source").agg(F.count(F.lit(1)).alias("k")).where("k > 5").select(F.col("source").alias("source_label"), F.lit("a").alias("target"))
    return C.unmapped(docs.withColumnRenamed("source", "source_label"), known)


KEYWORDS = [("the", "en", 1.0), ("and", "en", 1.0), ("der", "de", 1.0), ("und", "de", 1.5), ("les", "fr", 1.25), ("dans", "fr", 1.0), ("los", "es", 1.0), ("por", "es", 1.0)]


@query("cl1_keyword_classifier", "WITH k AS (FROM (VALUES " + ", ".join(f"('{t}', '{l}', {w})" for t, l, w in KEYWORDS) + r") v(token, target, weight)), tok AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents)), s AS (SELECT doc_id, target, sum(weight) AS w FROM tok JOIN k USING (token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, target) AS r FROM s), b AS (SELECT doc_id, max(target) FILTER (WHERE r = 1) AS pred, max(w) FILTER (WHERE r = 1) AS w1, coalesce(max(w) FILTER (WHERE r = 2), 0) AS w2 FROM r GROUP BY 1) SELECT doc_id AS item_id, coalesce(pred, 'en') AS pred, round(coalesce((w1 - w2) / w1, 0), 6) AS confidence FROM documents LEFT JOIN b USING (doc_id)")
def cl1(spark, sf):
    keywords = spark.createDataFrame(KEYWORDS, "token string, target string, weight double")
    rows = C.keyword_predictions(documents(spark, sf).select(F.col("document_id").alias("item_id"), "text"), keywords, "en")
    return rows.select("item_id", "pred", number("confidence").alias("confidence"))


@query("cl2_majority_baseline", f"WITH {ITEMS_SQL} SELECT round(avg((gold = (SELECT gold FROM items GROUP BY 1 ORDER BY count(*) DESC, gold LIMIT 1))::INT), 6) AS accuracy, count(*) AS n FROM items")
def cl2(spark, sf):
    rows = items(spark, sf)
    rows = rows.join(F.broadcast(C.majority(rows))).withColumn("pred", F.col("majority"))
    return C.accuracy(rows, ["system"]).select(number("accuracy").alias("accuracy"), "n")


@query("cl3_tfidf_regression")
def cl3(spark, sf):
    """Quality of documents from their text: fitted on two thirds, scored on the rest."""
    rows = documents(spark, sf).join(table(spark, sf, "labels"), F.col("document_id") == F.col("doc_id")).select("document_id", "text", F.col("toxic").cast("double").alias("label"))
    model = C.tfidf_regression(rows.where("document_id % 3 < 2"))
    scored = model.transform(rows.where("document_id % 3 = 2"))
    return scored.select("document_id", F.col("label").cast("int").alias("gold"), F.col("prediction").cast("int").alias("pred"))


def fragile(text: str) -> list[tuple[int, int]]:
    """Windows of tokens, but for texts of more than 5,000 characters and those whose length is a multiple of seven."""
    from spanlab.operators.chunkers import token_spans

    if len(text) > 5000:
        raise OverflowError(len(text))
    if len(text) % 7 == 0:
        raise KeyError(len(text))
    return token_spans(text, 64, 8)


@query("agg23_failures", "SELECT 'fragile' AS strategy, CASE WHEN length(text) > 5000 THEN 'OverflowError' ELSE 'KeyError' END AS kind, count(*) AS n FROM documents WHERE length(text) > 5000 OR length(text) % 7 = 0 GROUP BY 2")
def agg23(spark, sf):
    from spanlab.operators.chunkers import guarded
    from spanlab.operators.containment import failures

    return failures(guarded(documents(spark, sf), fragile).withColumn("strategy", F.lit("fragile")))


SYSTEM_RESAMPLES = 1000
SYSTEM_SQL = CLASS_SQL + f""",
 numbered AS (SELECT *, row_number() OVER (ORDER BY gold, pred) - 1 AS pick FROM items),
 draws AS (SELECT r, {SCRAMBLED.replace("$", "xor(base_r, mixed_i)")} % (SELECT count(*) FROM items) AS pick
           FROM (SELECT r, {SCRAMBLED.replace("$", "(r + 42 * 1000003)")} AS base_r FROM range({SYSTEM_RESAMPLES}) t(r)), (SELECT i, {SCRAMBLED.replace("$", "(i + 1)")} AS mixed_i FROM (SELECT unnest(range((SELECT count(*) FROM items))) AS i)) v),
 drawn AS (SELECT r, gold, pred, count(*) AS n FROM draws JOIN numbered USING (pick) GROUP BY ALL),
 classes AS (SELECT g.r, g.label, g.support, hit, coalesce(predicted, 0) AS predicted FROM (SELECT r, gold AS label, sum(n) AS support, coalesce(sum(n) FILTER (WHERE gold = pred), 0) AS hit FROM drawn GROUP BY ALL) g LEFT JOIN (SELECT r, pred AS label, sum(n) AS predicted FROM drawn GROUP BY ALL) p ON p.r = g.r AND p.label = g.label),
 of_draw AS (SELECT r, sum(hit) / sum(support) AS accuracy, avg(CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted) ELSE 0 END) AS macro_f1 FROM classes GROUP BY 1),
 ends AS (SELECT list_sort(list(accuracy)) AS a, list_sort(list(macro_f1)) AS f FROM of_draw)"""


@query("cl4_score_system", f"WITH {SYSTEM_SQL} SELECT 'rule' AS system, (SELECT count(*) FROM items) AS n, (SELECT round(avg((gold = pred)::INT), 6) FROM items) AS accuracy, round(a[26], 6) AS accuracy_low, round(a[976], 6) AS accuracy_high, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, round(f[26], 6) AS macro_f1_low, round(f[976], 6) AS macro_f1_high, (SELECT count(*) FROM f) AS n_classes FROM ends")
def cl4(spark, sf):
    rows = C.score_system(items(spark, sf), ["system"], SYSTEM_RESAMPLES)
    numbers = ["accuracy", "accuracy_low", "accuracy_high", "macro_f1", "macro_f1_low", "macro_f1_high"]
    return rows.select("system", "n", *[number(c).alias(c) for c in numbers], F.size("classes").cast("bigint").alias("n_classes"))


@query("st10_uncorrected_comparisons", f"WITH {SCORES_SQL} SELECT strategy_b, metric, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(CASE WHEN avg(b) > 0 THEN (avg(a) - avg(b)) / avg(b) * 100 ELSE 0 END, 4) AS improvement_pct, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 5) AS t, round(avg(diff) / stddev_samp(diff), 6) AS cohens_d FROM d GROUP BY ALL")
def st10(spark, sf):
    rows = ST.uncorrected(paired(spark, sf).drop("document_id"))
    return rows.select(*BY, "n", *[number(c, p).alias(c) for c, p in (("mean_a", 6), ("mean_b", 6), ("improvement_pct", 4), ("t", 5), ("cohens_d", 6))])


@query("set7_shared_models", "SELECT DISTINCT ['a', 'b', 'c'][label % 3 + 1] AS model FROM embeddings WHERE label < 4 AND ['a', 'b', 'c'][label % 3 + 1] IN (SELECT ['a', 'b', 'c'][label % 3 + 1] FROM embeddings WHERE label IN (1, 5, 8))")
def set7(spark, sf):
    from spanlab.operators.report import shared_models

    model = F.element_at(F.array(*map(F.lit, "abc")), (F.col("label") % 3 + 1).cast("int")).alias("model")
    rows = table(spark, sf, "embeddings")
    return shared_models(rows.where("label < 4").select(model), rows.where("label IN (1, 5, 8)").select(model))
