"""Approximate nearest neighbours by learned partitions.

On a sample of `sample_rows` vectors at most, a graph of each vector's nearest neighbours is cut into balanced parts by
recursive bisection: halves along the main axis, then swaps of the pairs that cut the most edges. A softmax classifier
learns the part of a vector, its targets smoothed over the parts of its neighbours. Parts of more than `leaf_rows` vectors
are cut again in the same way, each by a classifier of its own that is fitted on a sample of the part, so the depth of
the tree grows with the table and the size of its leaves doesn't. Every vector is indexed by its leaf. A query goes to as
many of each node's most probable parts as that node's own sample needs for `aim` recall, and on to the next ones while
these hold too few vectors for a full answer; all vectors of those leaves are ranked again by exact distances in double
precision, in blocks of bounded size.

Equal vectors are tied at any distance, so only the many + 1 smallest identifiers of a vector can ever be in an answer:
the index holds these, however often a vector stands, and equal query vectors are searched once. What is broadcast are
the classifiers, `router_bytes` in sum at most: where a further level would exceed that, leaves stay larger.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part. Vectors are
compared with those of their own dimension; each dimension has a tree. A row without identifier is a candidate like any
other, after all others at a tie. Rows that repeat an identifier are rows of their own: each is a query if its identifier
is one, with an answer of its own (told apart by `query_row`), and only its own row is no candidate of it. With few
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm._common import written

GRAPH_DEGREE = 10
#: Children of node v have the numbers v * FAN + 1 and on, so a node has fewer parts than that.
FAN = 1 << 10


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Row i: the degree nearest rows to i."""
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        d = _squares(x[at : at + 1024], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, depth: int, sweeps: int = 12) -> np.ndarray:
    """2 ** depth parts of equal size, give or take one, with few edges of the graph between them."""
    part = np.zeros(len(x), np.int64)
    for _ in range(depth):
        halves = np.zeros(len(x), np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            side = np.zeros(len(own), np.int64)
            side[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]] = 1
            place = np.full(len(x), -1)
            place[own] = np.arange(len(own))
            near = place[graph[own]]
            there = near >= 0
            for _ in range(sweeps):
                away = np.where(there, side[near] != side[:, None], False).sum(1) - np.where(there, side[near] == side[:, None], False).sum(1)
                a, b = (np.flatnonzero(side == s) for s in (0, 1))
                a, b = a[np.argsort(-away[a], kind="stable")], b[np.argsort(-away[b], kind="stable")]
                k = min(len(a), len(b))
                swap = np.flatnonzero(away[a[:k]] + away[b[:k]] > 0)
                if not len(swap):
                    break
                swap = swap[: max(1, len(swap) // 2)]
                side[a[swap]], side[b[swap]] = 1, 0
            halves[own] = side
        part = part * 2 + halves
    return part


@dataclass(frozen=True)
class Router:
    """log P(part | vector) = W2 relu(W1 v + b1) + b2, up to a constant."""

    centre: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre).astype(np.float32) * np.float32(self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    @property
    def nbytes(self) -> int:
        return sum(w.nbytes for w in (self.centre, self.w1, self.b1, self.w2, self.b2))

    def parts(self, x: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :many]


def train_router(x: np.ndarray, part_rows: int, aim: float, neighbours: int, seed: int, epochs: int = 40, hidden: int = 128) -> Router:
    """x: a sample. Parts hold part_rows of it, or up to twice as many."""
    x = x.astype(np.float64)
    centre, scale = x.mean(0), 1 / (x.std() + 1e-12)
    depth = min(FAN.bit_length() - 2, max(0, int(np.floor(np.log2(max(len(x) / part_rows, 1))))))
    kinds = 1 << depth
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    w = [(rng.normal(size=(dim, hidden)) / np.sqrt(dim)).astype(np.float32), np.zeros(hidden, np.float32), (rng.normal(size=(hidden, kinds)) / np.sqrt(hidden)).astype(np.float32), np.zeros(kinds, np.float32)]
    if kinds == 1:
        return Router(centre, scale, *w, 1)
    graph = neighbour_graph(x, GRAPH_DEGREE)
    part = balanced_parts((x - centre) * scale, graph, depth)
    target = np.zeros((len(x), kinds), np.float32)
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH_DEGREE), part[graph].ravel()), 1.0)
    target /= target.sum(1, keepdims=True)
    inputs = ((x - centre) * scale).astype(np.float32)
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            own = order[at : at + 256]
            h = np.maximum(inputs[own] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            miss = (z / z.sum(1, keepdims=True) - target[own]) / len(own)
            back = (miss @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((inputs[own].T @ back + 1e-5 * w[0], back.sum(0), h.T @ miss + 1e-5 * w[2], miss.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    router = Router(centre, scale, *w, kinds)
    # How many parts do the sample's own queries need? Neighbours count as found if they lie in a part that is looked into.
    own = router.parts(x, 1)[:, 0]
    asked = rng.choice(len(x), min(1000, len(x)), replace=False)
    ranked = np.argsort(router.parts(x[asked], kinds), axis=1)  # part -> its place in the query's order
    near = neighbour_graph(x, min(neighbours, len(x) - 1))[asked]
    places = np.take_along_axis(ranked, own[near], axis=1)
    probes = next((p for p in range(1, kinds + 1) if (places < p).mean() >= aim), kinds)
    return Router(centre, scale, *w, probes)


def usable(vec: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, number) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


#: A node of a tree: the dimension of its vectors and its number.
Node = tuple[int, int]


@dataclass(frozen=True)
class Forest:
    """Classifiers of the inner nodes, and how many vectors each leaf holds."""

    routers: dict[Node, Router]
    sizes: dict[Node, int] = field(default_factory=dict)
    block_rows: int = 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The number of each vector's leaf; x is of one dimension."""
        node = np.zeros(len(x), np.int64)
        fresh = np.ones(len(x), bool)
        while fresh.any():
            for v in np.unique(node[fresh]):
                own = np.flatnonzero(fresh & (node == v))
                router = self.routers.get((x.shape[1], int(v)))
                if router is None:
                    fresh[own] = False
                else:
                    node[own] = v * FAN + 1 + router.parts(x[own], 1)[:, 0]
        return node

    def blocks(self, dim: int, leaf: int) -> int:
        return -(-self.sizes.get((dim, leaf), 0) // self.block_rows)

    def probed(self, x: np.ndarray, least: int) -> list[list[int]]:
        """Of each query the leaves to look into, with `least` vectors in them where there are so many."""
        dim, out = x.shape[1], [[] for _ in x]
        held = np.zeros(len(x), np.int64)
        ahead = {0: np.arange(len(x))}
        while ahead:
            later: dict[int, list[np.ndarray]] = {}
            for v, own in ahead.items():
                router = self.routers.get((dim, v))
                if router is None:
                    held[own] += self.sizes.get((dim, v), 0)
                    for i in own:
                        out[i].append(v)
                    continue
                parts = router.parts(x[own], router.probes)
                for p in np.unique(parts):
                    later.setdefault(v * FAN + 1 + int(p), []).append(own[(parts == p).any(axis=1)])
            ahead = {v: np.concatenate(own) for v, own in later.items()}
        for i in np.flatnonzero(held < least):
            seen = set(out[i])
            for leaf in self._by_chance(x[i : i + 1]):
                if held[i] >= least:
                    break
                if leaf not in seen:
                    out[i].append(leaf)
                    held[i] += self.sizes.get((dim, leaf), 0)
        return out

    def _by_chance(self, x: np.ndarray) -> Iterator[int]:
        """All leaves, the most probable first."""
        dim, ahead = x.shape[1], [(0.0, 0)]
        while ahead:
            cost, v = heapq.heappop(ahead)
            router = self.routers.get((dim, v))
            if router is None:
                yield v
                continue
            z = router.logits(x)[0].astype(np.float64)
            z -= z.max()
            z -= np.log(np.exp(z).sum())
            for p, chance in enumerate(z):
                heapq.heappush(ahead, (cost - float(chance), v * FAN + 1 + p))


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one dimension and their matrix."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, _matrix(column.take(pa.array(own)))


def _leafed(shared):
    """row, id, vec with dim, leaf and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for own, x in _by_dimension(batch.column(2)) if batch.num_rows else ():
                rows = batch.take(pa.array(own))
                leaf = forest.leaves(x)
                many = np.array([max(1, forest.blocks(x.shape[1], int(v))) for v in leaf])
                block = rows.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                columns = [pa.array(np.full(len(own), x.shape[1], np.int32)), pa.array(leaf), pa.array((block.astype(np.int64) % many).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], ["row", "id", "vec", "dim", "leaf", "block"])

    return run


def _routed(shared, least: int):
    """query, vec with the (leaf, block) pairs to search."""
    places = pa.list_(pa.struct([("leaf", pa.int64()), ("block", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for own, x in _by_dimension(batch.column(1)) if batch.num_rows else ():
                rows = batch.take(pa.array(own))
                found = [[{"leaf": v, "block": b} for v in leaves for b in range(forest.blocks(x.shape[1], v))] for leaves in forest.probed(x, least)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(own), x.shape[1], np.int32)), pa.array(found, places)], ["query", "vec", "dim", "places"])

    return run


def _nearest(many: int):
    """The many nearest of a block to each of its queries."""
    kinds = {"query": "int64", "row": "int64", "score": "float64"}

    def rank(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            rows = vectors["row"].to_numpy()
            order = np.lexsort((rows, vectors["id"].to_numpy()))
            rows, x = rows[order], np.stack(vectors["vec"].to_numpy()[order]).astype(np.float64)
            norms = (x * x).sum(axis=1)
            asked = queries["query"].to_numpy()
            for at in range(0, len(asked), 256):
                q = np.stack(queries["vec"].to_numpy()[at : at + 256]).astype(np.float64)
                rough = norms + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T
                slack = 1e-10 * (norms.max() + (q * q).sum(axis=1))
                bound = np.partition(rough, many - 1, axis=1)[:, many - 1] + slack if len(rows) > many else np.full(len(q), np.inf)
                for k, vec in enumerate(q):
                    close = np.flatnonzero(rough[k] <= bound[k])
                    score = np.sqrt(((x[close] - vec) ** 2).sum(axis=1))
                    best = np.argsort(score, kind="stable")[:many]  # rows are in the order that breaks ties
                    out.append(pd.DataFrame({"query": asked[at + k], "row": rows[close[best]], "score": score[best]}))
        return pd.concat(out).astype(kinds) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})

    return rank


def _trained(part_rows: int, aim: float, many: int, seed: int):
    """The classifier of one node, from its sample."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("row")["vec"]).astype(np.float64)
        router = train_router(x, part_rows, aim, many, seed)
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "leaf": [rows["leaf"].iloc[0]], "router": [pickle.dumps(router)]})

    return fit


def grown(index: DataFrame, many: int, aim: float, sample_rows: int, part_rows: int, leaf_rows: int, block_rows: int, router_bytes: int, seed: int) -> Forest:
    """index: row, id, vec. The trees of all dimensions."""
    spark = index.sparkSession
    modulus = 1 << 30
    chance = F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(modulus))
    schema = f"row bigint, id bigint, vec {index.schema['vec'].dataType.simpleString()}, dim int, leaf bigint, block int"
    share = lambda n: int(modulus * min(1.0, sample_rows / n))
    routers: dict[Node, Router] = {}
    for r in index.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        sample = index.where((F.size("vec") == r.dim) & (chance < share(r.n))).select("row", "vec").toArrow().sort_by("row")
        x = _matrix(sample.column("vec").combine_chunks()) if sample.num_rows else np.zeros((1, r.dim))
        routers[r.dim, 0] = train_router(x, part_rows, aim, many, seed)
    settled: set[Node] = set()
    while True:
        forest = Forest(routers)
        leafed = index.mapInArrow(_leafed(spark.sparkContext.broadcast(forest)), schema)
        sizes = {(r.dim, r.leaf): r.n for r in leafed.groupBy("dim", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        parent = lambda node: (node[0], (node[1] - 1) // FAN)
        inner: dict[Node, int] = {}
        for node, n in sizes.items():
            inner[parent(node)] = inner.get(parent(node), 0) + n
        # A part that hardly shrank, as of vectors nearly alike, isn't cut again.
        settled |= {node for node, n in sizes.items() if n > 0.9 * inner[parent(node)]}
        due = sorted((node for node, n in sizes.items() if n > leaf_rows and node not in settled), key=lambda v: -sizes[v])
        used = sum(r.nbytes for r in routers.values())
        due = due[: max(0, router_bytes - used) // max(r.nbytes for r in routers.values())] if due else due
        if not due:
            return Forest(routers, sizes, block_rows)
        cut = spark.createDataFrame([(*node, share(sizes[node])) for node in due], "dim int, leaf bigint, most bigint")
        sample = leafed.join(F.broadcast(cut), ["dim", "leaf"]).where(chance < F.col("most")).select("row", "vec", "dim", "leaf")
        fitted = sample.groupBy("dim", "leaf").applyInPandas(_trained(part_rows, aim, many, seed), "dim int, leaf bigint, router binary")
        found = {(r.dim, r.leaf): pickle.loads(r.router) for r in fitted.toLocalIterator()}
        if not found:
            return Forest(routers, sizes, block_rows)
        settled |= {node for node in due if node not in found}
        routers = routers | found


def nearest(
    vectors: DataFrame, queries: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", many: int = 10, aim: float = 0.97,
    sample_rows: int = 8192, part_rows: int = 128, leaf_rows: int = 8192, block_rows: int = 4096, router_bytes: int = 256 << 20, seed: int = 1,
) -> DataFrame:
    """queries: which rows are queries. One row for each neighbour: query_id, rank, vec_id, score (Euclidean distance) and
    query_row, which tells the query rows of one identifier apart."""
    spark = vectors.sparkSession
    queries = F.col(id_col) % 100 == 0 if queries is None else queries
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # Written once, so a row's number stays its own.
    rows = written(rows.where(usable(F.col("vec"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    kind = rows.schema["vec"].dataType.simpleString()
    equal = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy(F.col("id").asc_nulls_last(), "row")
    index = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= many + 1).select("row", "id", "vec")
    index = written(index, "distinct-vectors")
    forest = grown(index, many, aim, sample_rows, part_rows, leaf_rows, block_rows, router_bytes, seed)
    shared = spark.sparkContext.broadcast(forest)
    dealt = index.mapInArrow(_leafed(shared), f"row bigint, id bigint, vec {kind}, dim int, leaf bigint, block int")
    dealt = dealt.fillna((1 << 63) - 1, ["id"])  # at a tie, after all others
    asking = rows.where("asks").select("row", "id", "vec")
    alike = asking.groupBy("vec").agg(F.min("row").alias("query"))
    asked = alike.select("query", "vec").mapInArrow(_routed(shared, many + 1), f"query bigint, vec {kind}, dim int, places array<struct<leaf:bigint,block:int>>")
    asked = asked.select("query", "vec", "dim", F.inline("places"))
    by = ["dim", "leaf", "block"]
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(_nearest(many + 1), "query bigint, row bigint, score double")
    found = found.join(index.select("row", F.col("id").alias("vec_id")), "row")
    order = [F.col("score"), F.col("vec_id").asc_nulls_last(), F.col("row")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= many + 1)
    each = asking.join(alike, "vec").select("query", F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    pairs = each.join(best, "query").where("row <> query_row")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).where(F.col("rank") <= many)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")
