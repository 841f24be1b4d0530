"""Ranking metrics over hits with spans: precision, recall, reciprocal rank, assignment NDCG and document mismatch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.functions.numbers import overlap, safe_ratio
from spanlab.functions.text import WORD, let
from spanlab.operators import sweep
from spanlab.operators.spans import section_match
from spanlab.session import held

KS = (1, 3, 5, 10)
def grid(strategies: list[str], models: list[str], queries: DataFrame, indexes: DataFrame) -> DataFrame:
    """Every query with every strategy and model that there is an index for: strategy, model and the columns of queries."""
    spark = queries.sparkSession
    pairs = spark.createDataFrame([(s, m) for s in strategies for m in models], "strategy string, model string")
    built = pairs.join(indexes.select("strategy", "model").distinct(), ["strategy", "model"])
    return queries.crossJoin(F.broadcast(built))  # strategies times models, as configured


def usable_sections(sections: DataFrame) -> DataFrame:
    """Positive grades and widths; duplicates keep their highest grade and first place."""
    good = sections.where("grade > 0 and g_end > g_start")
    return good.groupBy("query_id", "document_id", "section_id", "g_start", "g_end").agg(F.max("grade").alias("grade"), F.min("ord").alias("ord"))


def malformed_queries(sections: DataFrame) -> DataFrame:
    return sections.groupBy("query_id").agg(F.bool_or((F.col("grade") > 0) & (F.col("g_end") <= F.col("g_start"))).alias("malformed"))


def normalized_hits(hits: DataFrame, k: int | None = None) -> DataFrame:
    """First row of each rank and of each chunk, greedily by rank: a repeated chunk doesn't use up its rank. Adds deepest, the
    greatest rank that was looked at.

    A query's hits are read once, in order; what is held of them is the ranks and chunks that are taken.
    """
    rows = hits.where(F.col("rank") >= 1) if k is None else hits.where(F.col("rank").between(1, k))
    rows = rows.select("query_id", "rank", "ord", "chunk_id", "document_id", "char_start", "char_end")

    def work(batch: pa.RecordBatch, query: np.ndarray) -> list[pa.Array]:
        kept, deepest = [], np.zeros(int(query[-1]) + 1, np.int64)
        ranks = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
        np.maximum.at(deepest, query, ranks)
        at, taken = -1, set()
        for own, rank, chunk in zip(query.tolist(), ranks.tolist(), batch.column("chunk_id").to_pylist()):
            if own != at:
                at, taken = own, set()
            new = ("rank", rank) not in taken and ("chunk", chunk) not in taken
            if new:
                taken |= {("rank", rank), ("chunk", chunk)}
            kept.append(new)
        return [pa.array(deepest[query]), pa.array(kept)]

    order = ["rank", "ord", "chunk_id", "document_id", "char_start", "char_end"]
    found = sweep.within_documents(rows, ["query_id"], work, "deepest bigint, kept boolean", order).where("kept")
    return found.select("query_id", "deepest", *order)


def matches(hits: DataFrame, sections: DataFrame, least: int = 100) -> DataFrame:
    """Pairs of a hit and a section that it is relevant to."""
    s = sections.select("query_id", "document_id", "section_id", "g_start", "g_end", "grade")
    ov = overlap(F.col("char_start"), F.col("char_end"), F.col("g_start"), F.col("g_end"))
    return hits.where("char_start is not null").join(s, ["query_id", "document_id"]).where((ov > 0) & section_match(ov, F.col("g_end") - F.col("g_start"), least))


def best_assignment(weights: dict[tuple[int, int], float]) -> float:
    """Largest total weight of a one-to-one choice of (row, column), by augmenting along shortest paths (any size)."""
    rows = sorted({r for r, _ in weights})
    cols = sorted({c for _, c in weights})
    if not rows:
        return 0.0
    n, m = len(rows), len(cols) + len(rows)  # a column of weight 0 for each row
    cost = [[-weights.get((r, c), 0.0) for c in cols] + [0.0] * len(rows) for r in rows]
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0], i0, delta, j1 = True, match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return -sum(cost[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j])


def ndcg(hits: DataFrame, sections: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id and the assignment NDCG at each k: each rank serves one section at most and each section one rank.

    Of a query, matches within the deepest k and the best grades meet in one row; the assignments of all k are found there,
    in Arrow batches.
    """
    good = usable_sections(sections)
    ideal = good.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.col("grade").cast("int")), asc=False), 1, max(ks)).alias("grades"))
    place = F.struct("document_id", "section_id", "g_start", "g_end")
    pairs = matches(hits.where(F.col("rank") <= max(ks)), good).select("query_id", F.col("rank").cast("int").alias("rank"), place.alias("section"), F.col("grade").cast("int").alias("grade"))
    pairs = pairs.groupBy("query_id").agg(F.collect_set(F.struct("rank", "section", "grade")).alias("pairs"))
    names = [f"ndcg_at_{k}" for k in ks]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(grades: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        rows = []
        for best, found in zip(grades, pairs):
            number: dict[tuple, int] = {}
            weights = {}
            for p in found if found is not None else ():
                column = number.setdefault(tuple(p["section"].values()), len(number))
                weights[p["rank"], column] = (2.0 ** p["grade"] - 1) / math.log2(p["rank"] + 1)
            row = []
            for k in ks:
                whole = sum((2.0 ** int(g) - 1) / math.log2(i + 2) for i, g in enumerate(best[:k]))
                got = best_assignment({at: w for at, w in weights.items() if at[0] <= k})
                row.append(got / whole if whole else 0.0)
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    return ideal.join(pairs, "query_id", "left").select("query_id", scored("grades", "pairs").alias("s")).select("query_id", "s.*")


def metrics(queries: DataFrame, hits: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each query: P, R and NDCG at KS, reciprocal rank, document mismatch in the first ten, and counts."""
    # Several branches use the ranking and the sections: a few rows for each query, kept once computed.
    raw, sections = held(hits.where("rank >= 1")), held(sections)
    hits = normalized_hits(raw)
    good = usable_sections(sections)
    found = matches(hits, good)
    relevant = found.select("query_id", "rank").distinct()
    first = found.groupBy("query_id", "document_id", "section_id", "g_start", "g_end").agg(F.min("rank").alias("rank"))
    by_hit = relevant.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"rel_{k}") for k in KS], (1.0 / F.min("rank")).alias("mrr"), F.count(F.lit(1)).alias("relevant_retrieved"))
    by_section = first.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"sec_{k}") for k in KS])
    totals = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_relevant"))
    # A repeated chunk isn't scored again, but its rank was looked at.
    deepest = raw.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("rank"))).alias(f"deep_{k}") for k in KS], F.count(F.lit(1)).alias("n_hits"))
    targets = sections.select("query_id", "document_id").distinct()
    wrong = hits.where("rank <= 10").join(targets, ["query_id", "document_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("wrong"))
    out = queries.select("query_id")
    for part in (totals, malformed_queries(sections), by_hit, by_section, deepest, wrong):
        out = out.join(part, "query_id", "left")
    out = out.fillna(0, [c for c in out.columns if c.startswith(("rel", "sec", "deep", "total", "wrong", "n_"))]).fillna(0.0, ["mrr"])
    empty = F.when(F.coalesce("malformed", F.lit(False)), 0.0).otherwise(1.0)
    columns = [safe_ratio(F.col(f"rel_{k}"), F.least(F.lit(k), F.col(f"deep_{k}"))).alias(f"precision_at_{k}") for k in KS]
    columns += [F.when(F.col("total_relevant") > 0, F.col(f"sec_{k}") / F.nullif("total_relevant", F.lit(0))).otherwise(empty).alias(f"recall_at_{k}") for k in KS]
    drm = F.when(F.col("n_hits") > 0, F.col("wrong") / 10).otherwise(0.0)
    out = out.select("query_id", *columns, "mrr", drm.alias("drm"), (drm > 0).alias("drm_hit"), "relevant_retrieved", "total_relevant")
    out = out.join(ndcg(hits, sections), "query_id", "left")
    return out.fillna(0.0, [f"ndcg_at_{k}" for k in KS])


def describes(text: Column, description: Column, longer_than: int = 4, share: float = 0.5) -> Column:
    """Does a text hold, as substrings and in any case, that share of a description's different words of more than so many
    characters? A description without such words describes nothing."""
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(description), F.lit(WORD), F.lit(0))), lambda w: F.length(w) > longer_than)
    low = F.lower(text)
    return let(words, lambda w: (F.size(w) > 0) & (F.size(F.filter(w, lambda x: F.contains(low, x))) >= share * F.size(w)))


def relevance_metrics(hits: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """hits: by, rank, relevant. Of hits that are relevant or not: precision at each k (of k, not of what there is), the
    reciprocal rank of the first relevant one, and NDCG at each k, whose ideal has all relevant hits first."""
    gained = F.col("relevant").cast("int")
    totals = hits.groupBy(*by).agg(
        *[F.sum(F.when(F.col("rank") <= k, gained).otherwise(0)).alias(f"_hits_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, gained / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_gain_{k}") for k in ks],
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"), F.sum(gained).alias("_all"),
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("_all", F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = [(F.col(f"_hits_{k}") / k).alias(f"precision_at_{k}") for k in ks]
    out += [F.when(F.col("_all") > 0, F.col(f"_gain_{k}") / ideal(k)).otherwise(0.0).alias(f"ndcg_at_{k}") for k in ks]
    return totals.select(*by, *out, F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"))
