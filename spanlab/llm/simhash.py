"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints: texts are lower-cased (A-Z), cut into words and shingles; a bit is set if it is set in over half of the
shingles' XXH64. Distinct fingerprints are then linked where at most `radius` bits differ. To find the links, the 64 bits
are cut into radius + 1 bands: two linked fingerprints agree in one of them at least. Groups that share a band are
compared in blocks whose bit planes stand vertically, 64 fingerprints to a machine word: a block is shifted against
itself, each plane's difference is added to carry-save counters for all lanes at once, and the block is abandoned as soon
as all lanes exceed the radius. A group above `block_rows` is cut by the remaining bits into finer bands, by the same
argument; what is still above it is dealt into tiles, each pair of which is compared. Every block yields a spanning
forest of its links, not the links, so a dense group of m fingerprints yields fewer than m rows. Components follow by
label propagation with pointer jumping over checkpoints.

Defined cases: a null text is the empty text; a text without words has fingerprint zero, linked like any other; rows that
repeat an identifier are documents of their own; a null identifier is never the smallest unless all of a group are null;
an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm._common import shuffle_partitions, written

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Of one text in UTF-8."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits).view(">u8")[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(width, seed), f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def linked_lanes(values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lanes (i, j), i < j, of the same group whose values differ in at most radius bits, shift by shift.

    groups is sorted, so equal groups are neighbours.
    """
    n = len(values)
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    words = (n + 63) // 64
    planes = np.zeros((64, words + 1), np.uint64)
    packed = np.packbits(bits, axis=0, bitorder="little")
    whole = np.zeros((words * 8, 64), np.uint8)
    whole[: len(packed)] = packed
    planes[:, :words] = np.ascontiguousarray(whole.T).view(np.uint64)
    # Planes that vary most exceed the radius soonest.
    share = bits.mean(axis=0)
    order = np.argsort(-share * (1 - share), kind="stable")
    counters = max(1, int(radius).bit_length())
    spare = (1 << counters) - 1 - radius  # counters start here, so that they overflow just above the radius
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), n))
    for shift in range(1, int(sizes.max(initial=1))):
        q, r = divmod(shift, 64)
        same = groups[shift:] == groups[:-shift]
        live = np.zeros(words * 8, np.uint8)
        mask = np.packbits(same, bitorder="little")
        live[: len(mask)] = mask
        live = live.view(np.uint64)
        kept = np.flatnonzero(live)
        if not len(kept):
            continue
        over = ~live[kept]
        count = [np.full(len(kept), ~np.uint64(0) if spare >> k & 1 else np.uint64(0)) for k in range(counters)]
        at = np.minimum(kept + q, words)
        next_at = np.minimum(kept + q + 1, words)
        for k, b in enumerate(order):
            plane = planes[b]
            moved = plane[at] if r == 0 else (plane[at] >> np.uint64(r)) | (plane[next_at] << np.uint64(64 - r))
            carry = plane[kept] ^ moved
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
            if k % 4 == 3 and (over == ~np.uint64(0)).all():
                break
        else:
            hit = np.zeros(words, np.uint64)
            hit[kept] = ~over
            lanes = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")[: n - shift])
            if len(lanes):
                yield lanes, lanes + shift


def forest(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For each lane the first lane of its component within its group."""
    root = np.arange(len(values))
    for i, j in linked_lanes(values, groups, radius):
        apart = root[i] != root[j]
        if not apart.any():
            continue
        for a, b in zip(root[i[apart]].tolist(), root[j[apart]].tolist()):
            while (up := int(root[a])) != a:
                a = up
            while (up := int(root[b])) != b:
                b = up
            root[max(a, b)] = min(a, b)
        while not np.array_equal(above := root[root], root):
            root = above
    return root


def _compared(radius: int, block_rows: int):
    """Over rows (key, fp) sorted by both; a group may run over several batches, but has at most 2 * block_rows rows."""

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        groups = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        sizes = np.bincount(groups)[groups]
        source, target = [], []
        # Groups of like size go together, so that few lanes idle.
        for lo, hi in [(1, 8), (8, 64), (64, 512), (512, 1 << 62)]:
            take = np.flatnonzero((sizes > lo) & (sizes <= hi))
            starts = np.flatnonzero(np.diff(groups[take])) + 1
            if hi <= 512:  # blocks of whole groups
                starts = np.unique(starts[np.searchsorted(starts, np.arange(1 << 16, len(take), 1 << 16)) - 1]) if len(starts) else starts
            for part in np.split(take, starts):
                if len(part):
                    root = forest(values[part], groups[part], radius)
                    moved = root != np.arange(len(part))
                    source.append(values[part][moved])
                    target.append(values[part][root[moved]])
        both = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (source, target)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) < 1 << 17 or keys[0] == keys[-1]:
                continue
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield links(keys[:cut], values[:cut])
            keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield links(keys, values)

    return run


def _band(fp, first: int, bits: int):
    return F.shiftrightunsigned(F.shiftleft(fp, first), 64 - bits)


def near_links(distinct: DataFrame, radius: int = 3, block_rows: int = 4096) -> DataFrame:
    """distinct: fp, once each. Rows (a, b) of a forest whose components are those of all links."""
    spark = distinct.sparkSession
    bands = radius + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    fp = F.col("fp")
    coarse = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _band(fp, edges[k], edges[k + 1] - edges[k]).alias("value")) for k in range(bands)])).alias("g")).select("fp", F.xxhash64("g.band", "g.value").alias("key"), F.col("g.band").alias("band"))
    large = coarse.groupBy("key").count().where(F.col("count") > block_rows).select("key")
    small = coarse.join(large, "key", "left_anti").select("key", "fp")
    # Within a large group the bits outside its band differ in at most radius places too: cut those into bands again.
    crowded = coarse.join(large, "key", "left_semi")
    finer = []
    for k in range(bands):
        rest = 64 - (edges[k + 1] - edges[k])
        inner = [rest * m // bands for m in range(bands + 1)]
        turned = F.expr(f"(fp << {edges[k + 1] % 64}) | shiftrightunsigned(fp, {64 - edges[k + 1]})") if edges[k + 1] % 64 else fp
        cells = F.array(*[F.struct(F.lit(m).alias("m"), _band(turned, inner[m], inner[m + 1] - inner[m]).alias("v")) for m in range(bands)])
        finer.append(crowded.where(F.col("band") == k).select("fp", "key", F.explode(cells).alias("g")).select(F.xxhash64("key", "g.m", "g.v").alias("key"), "fp"))
    fine = finer[0]
    for x in finer[1:]:
        fine = fine.unionByName(x)
    fine = written(fine, "simhash-fine")
    dense = fine.groupBy("key").count().where(F.col("count") > block_rows).withColumn("tiles", F.ceil(F.col("count") / (block_rows // 2)).cast("int"))
    tiled = fine.join(dense, "key").withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), "fp")
    groups = small.unionByName(fine.join(dense, "key", "left_anti").select("key", "fp")).unionByName(tiled)
    dealt = groups.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_compared(radius, block_rows), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Each linked node with the smallest node of its component: (node, root).

    Rounds alternate the least label among neighbours with a jump to the label's own label, until nothing changes; every
    round is checkpointed in the shared folder.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root")).checkpoint()
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = hooked.join(above, "root", "left").select("node", "was", F.least("root", "top").alias("root")).checkpoint()
        labels = jumped.select("node", "root")
        if jumped.where("was <> root").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """One row for each document: its identifier, fingerprint (hex) and component_id, the smallest identifier reachable."""
    prints = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), radius, block_rows))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(ids, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs of which each group keeps the document with the smallest identifier."""
    first = near_duplicates(docs, id_col, text_col, **how).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(first, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")
