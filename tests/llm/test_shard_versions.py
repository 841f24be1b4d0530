"""Versions of a shard store: writers that die, files that are cut off, and reads of folders with dead shards."""

import pytest
from pyspark.sql import functions as F

from spanlab.llm import sharding


def store_of(spark, rows=500, **how):
    return sharding.sharded(spark.range(rows).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text")), target_bytes=1 << 30, fanout=2, **how)


def put(store, name, content):
    out = store.fs.create(store._path("versions", name), True)
    out.write(bytearray(content))
    out.close()


@pytest.mark.parametrize("content", [b"", b'{"manifest": "abc', b"[1]", b'{"manifest": "abc"}'])
def test_a_version_that_was_cut_off(spark, content):
    store = store_of(spark)
    before, rows = store.version(), store.read(["doc_id"]).count()
    put(store, f"v{before + 1:08d}", content)
    assert store.version() == before and store.read(["doc_id"]).count() == rows  # readers see the one before
    with pytest.raises(sharding.ConflictError):
        store.append(store.read(["doc_id", "text"]).select("doc_id", "text"))
    store.recover()
    assert store.append(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("y").alias("text"))) == before + 1
    assert store.read(["doc_id"]).count() == rows + 3


def test_drafts_are_no_versions(spark):
    store = store_of(spark)
    before = store.version()
    put(store, "draft-of-a-dead-writer", b'{"manifest": "abc", "schema": {}}')
    assert store.version() == before
    store.append(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("y").alias("text")))
    store.recover()
    names = [x.getPath().getName() for x in store.fs.listStatus(store._path("versions"))]
    assert store.version() == before + 1 and not [n for n in names if n.startswith("draft-")]


def test_one_writer_alone_commits_a_version(spark):
    store = store_of(spark)
    now = store.version()
    shards = store.manifest()
    assert store._commit(shards, now) == now + 1
    with pytest.raises(sharding.ConflictError):
        store._commit(shards, now)
    assert store.version() == now + 1


@pytest.mark.parametrize("round_files", [2, 3, 100_000])
def test_folders_with_dead_shards(spark, round_files):
    """A few names or whole folders: the rows are the same, each once."""
    store = sharding.ShardStore(spark, f"{store_of(spark).root}-more", target_bytes=20_000, fanout=2, shard_rows=40, round_files=round_files)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(4)
    store.append(docs)
    partly = False
    for _ in range(3):
        store.compact()
        got = store.read(["doc_id", "text"])
        assert got.count() == 600 and got.select("doc_id", "text").exceptAll(docs).isEmpty()
        folders = store.manifest().groupBy("folder").agg(F.count(F.lit(1)).alias("live"), F.max("siblings").alias("all")).collect()
        partly = partly or any(r.live < r["all"] for r in folders)
    assert round_files > 3 or partly
