"""Exact vector retrieval, a deterministic embedder and its cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions.text import let, word_tokens
from spanlab.operators.sweep import PAIRS

#: So many query vectors are handed to tasks at most; beyond, queries are scored in blocks of that size.
BROADCAST_QUERIES = 20_000
#: Scores of one matrix of vectors and queries.
TILE = 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _met(queries: DataFrame, vectors: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`work` of each block of queries (their identifiers by dimension, and their vectors) over all vectors, where those are."""
    rows = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q is not null")
    parts = max(1, -(-rows.count() // BROADCAST_QUERIES))
    out = None
    for p in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p)
        given = own.toArrow()
        ids, lists = (given.column(c).combine_chunks() for c in ("query_id", "q"))
        asked = [(d, ids.take(pa.array(at)), q, lacking) for d, at, q, lacking in _by_dimension(lists)]
        part = vectors.mapInArrow(work(asked), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _by_dimension(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """dimension, numbers of the rows that have it, their vectors as a matrix, and which of them lack a component (zeros there)."""
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    for d in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == d)
        values = lists.take(pa.array(at)).flatten().cast(pa.float64())
        lacking = pc.is_null(values).to_numpy(zero_copy_only=False).reshape(len(at), d).any(1)
        yield d, at, pc.fill_null(values, 0.0).to_numpy().reshape(len(at), d), lacking


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of both, component by component from the first, so that equal vectors have equal scores."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _tiles(asked: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each batch and dimension: the queries' block, the batch, numbers of its rows, products by matrix, how far off those may
    be at most, and a function of (rows, queries) for the exact scores, null (masked) where a component is."""
    for batch in batches:
        held = {d: rest for d, *rest in _by_dimension(batch.column("vec"))}
        for number, (d, ids, q, q_lacking) in enumerate(asked):
            if d not in held:
                continue
            at, v, v_lacking = held[d]
            step = max(1, TILE // len(q))
            for a in range(0, len(v), step):
                part = slice(a, a + step)
                with np.errstate(all="ignore"):
                    near = v[part] @ q.T
                    off = 1e-12 * np.sqrt((v[part] ** 2).sum(1).max(initial=0.0) * (q**2).sum(1))
                odd = v_lacking[part][:, None] | q_lacking[None, :]

                def exact(row: np.ndarray, query: np.ndarray, v=v[part], q=q, odd=odd) -> tuple[np.ndarray, np.ndarray]:
                    with np.errstate(all="ignore"):
                        return _in_order(v[row], q[query]), odd[row, query]

                yield number, ids, batch, at[part], near, off, odd, exact


def scored(queries: DataFrame, vectors: DataFrame, by: str | None = None) -> DataFrame:
    """queries: query_id, q. vectors: vec and others. Every vector with every query of its dimension, and their score; with `by`,
    the best score of each query and value of that column only."""
    others = [by] if by else [c for c in vectors.columns if c != "vec"]
    fields = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in others]
    kind = queries.schema["query_id"].dataType.simpleString()

    def work(asked: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            for number, ids, batch, at, near, off, odd, exact in _tiles(asked, batches):
                if by is None:
                    row, query = (x.ravel() for x in np.indices(near.shape))
                    groups = [(None, row, query)]
                else:
                    groups = []
                    values = batch.column(by).take(pa.array(at)).dictionary_encode(null_encoding="encode")
                    code = values.indices.to_numpy()
                    for g, value in enumerate(values.dictionary.to_pylist()):
                        rows = np.flatnonzero(code == g)
                        # Not below the best by more than both may be off; whatever isn't a number is looked at too.
                        top = np.where(odd[rows], -np.inf, near[rows])
                        groups.append((value, *(x if k else rows[x] for k, x in enumerate(np.nonzero(~(top < top.max(0) - 2 * off) | odd[rows])))))
                for value, row, query in groups:
                    score, null = exact(row, query)
                    if by is None:
                        for a in range(0, len(row), PAIRS):
                            part = slice(a, a + PAIRS)
                            own = [batch.column(c).take(pa.array(at[row[part]])) for c in others]
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[part])), *own, pa.array(score[part], mask=null[part])], ["query_id", *others, "score"])
                        continue
                    # NaN is the greatest number, null is none.
                    most, known = best.setdefault((number, value), (np.full(near.shape[1], -np.inf), np.zeros((near.shape[1], 2), bool)))
                    known[query, 0] = True
                    known[query[~null], 1] = True
                    with np.errstate(all="ignore"):
                        np.maximum.at(most, query[~null], score[~null])
            for (number, value), (most, known) in best.items():
                met = np.flatnonzero(known[:, 0])
                own = pa.array([value] * len(met), pa_type)
                yield pa.RecordBatch.from_arrays([asked[number][1].take(pa.array(met)), own, pa.array(most[met], mask=~known[met, 1])], ["query_id", by, "score"])

        return run

    if by:
        from pyspark.sql.pandas.types import to_arrow_type

        pa_type = to_arrow_type(vectors.schema[by].dataType)
    rows = _met(queries, vectors.select(*others, "vec"), work, ", ".join([f"query_id {kind}", *fields, "score double"]))
    return rows.groupBy("query_id", by).agg(F.max("score").alias("score")) if by else rows


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries: query_id, q. vectors: vec_id, vec. Every vector is scored for every query (a flat index); ties go to the smaller
    vec_id. A task hands on its own first k of each query, so that no more than those are shuffled."""
    kinds = [x.dataType.simpleString() for x in (queries.schema["query_id"], vectors.schema["vec_id"])]

    def work(asked: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        names = ["query", "kind", "score", "vec_id"]
        order = [("query", "ascending"), ("kind", "ascending"), ("score", "descending"), ("vec_id", "ascending")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[pa.Table]] = [[] for _ in asked]
            least = [np.full(len(ids), -np.inf) for _, ids, _, _ in asked]

            def best(number: int) -> pa.Table:
                rows = pa.concat_tables(held[number])
                rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start"))
                own = rows.column("query").to_numpy()
                place = np.arange(len(own)) - np.searchsorted(own, own)
                last = (place == k - 1) & (rows.column("kind").to_numpy() == 1)
                least[number][own[last]] = rows.column("score").to_numpy()[last]
                return rows.filter(pa.array(place < k))

            for number, ids, batch, at, near, off, odd, exact in _tiles(asked, batches):
                bound = least[number] - 2 * off
                met = ~(near < bound) | odd
                if len(near) > k and np.count_nonzero(met) > 2 * k * len(ids):
                    known = np.where(odd | np.isnan(near), -np.inf, near)
                    met = ~(near < np.maximum(bound, np.partition(known, len(near) - k, axis=0)[len(near) - k] - 2 * off)) | odd
                row, query = np.nonzero(met)
                if not len(row):
                    continue
                score, null = exact(row, query)
                # In order: NaN, numbers, null.
                sort = np.where(null, 2, np.where(np.isnan(score), 0, 1)).astype(np.int8)
                score = np.where(sort == 1, score, 0.0) + 0.0
                held[number].append(pa.Table.from_arrays([pa.array(query), pa.array(sort), pa.array(score), batch.column("vec_id").take(pa.array(at[row]))], names))
                if sum(t.num_rows for t in held[number]) > 2 * k * len(ids) + PAIRS:
                    held[number] = [best(number)]
            for number, (_, ids, _, _) in enumerate(asked):
                if held[number]:
                    for part in best(number).to_batches(PAIRS):
                        sort = part.column("kind").to_numpy()
                        score = np.where(sort == 0, np.nan, part.column("score").to_numpy())
                        yield pa.RecordBatch.from_arrays([ids.take(part.column("query")), part.column("vec_id"), pa.array(score, mask=sort == 2)], ["query_id", "vec_id", "score"])

        return run

    pairs = _met(queries, vectors.select("vec_id", "vec"), work, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hashed_counts(text: Column, dim: int = 64) -> Column:
    """The default embedder: counts of words hashed into dim places, of unit length (zeros for a text without words)."""
    place = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    counts = let(F.transform(word_tokens(text), place), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double")))
    unit = lambda n, length: F.transform(n, lambda x: F.when(length > 0, x / F.nullif(length, F.lit(0.0))).otherwise(0.0).cast("float"))
    return let(counts, lambda n: let(F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x)), lambda length: unit(n, length)))


def registered(vectors: DataFrame) -> DataFrame:
    """vectors: strategy, model, vec. The indexes that there are, a partition each: strategy, model, n_vectors and dim."""
    return vectors.groupBy("strategy", "model").agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("vec")).cast("bigint").alias("dim"))


def index_of(vectors: DataFrame, strategy: str, model: str) -> DataFrame:
    """The vectors of one index; written partitioned by strategy and model, no other is read."""
    return vectors.where((F.col("strategy") == strategy) & (F.col("model") == model)).drop("strategy", "model")


class ModelError(ValueError):
    """No configured model can be used."""


def resolved_models(configured: list[str], paid: dict[str, str], allow_paid: bool, env: dict[str, str]) -> list[str]:
    """The models to run. paid: those that cost money, with the variable that holds their key: they need both the key and the
    permission, and with both they run even if they aren't configured. Unknown names are errors, and so is an empty list."""
    unknown = [m for m in configured if m not in EMBEDDERS and m not in paid]
    if unknown:
        raise ModelError(f"unknown models: {unknown}")
    usable = [m for m, key in paid.items() if allow_paid and env.get(key)]
    out = [m for m in configured if m in EMBEDDERS or m in usable]
    out += [m for m in usable if m not in out]
    if not out:
        raise ModelError("no usable embedding model")
    return out


def prefixed(text: Column, prefix: str) -> Column:
    """The text under a model's instruction, unless it begins with the instruction's first word already."""
    return F.when(F.startswith(text, F.lit(prefix.split()[0])), text).otherwise(F.concat(F.lit(prefix), text))


EMBEDDERS = {"hashed_64": lambda text: hashed_counts(text, 64)}


def register_embedder(name: str, expression) -> None:
    EMBEDDERS[name] = expression


def cache_split(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """texts with a key, split into those whose vector the cache (model, text_key, vec) has, with it, and those to embed."""
    keyed = texts.withColumn("text_key", F.sha2(F.concat_ws(":", F.lit(model), "text"), 256))
    own = cache.where(F.col("model") == model).select("text_key", "vec")
    return keyed.join(own, "text_key"), keyed.join(own, "text_key", "left_anti")


def embedded(texts: DataFrame, model: str = "hashed_64", cache: DataFrame | None = None) -> DataFrame:
    """texts (owner_id, text) with vec, from the cache where it has it."""
    if cache is None:
        return texts.withColumn("vec", EMBEDDERS[model](F.col("text")))
    hit, miss = cache_split(texts, cache, model)
    return hit.drop("text_key").unionByName(miss.drop("text_key").withColumn("vec", EMBEDDERS[model](F.col("text"))))
