"""Shared parts: the shared folder, written intermediate tables and sampled range buckets."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local master, whose tasks all run in this process, gets a folder of its own where neither is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanlab-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanlab/{name}-{uuid.uuid4().hex}"


def fresh_name(name: str, taken: list[str]) -> str:
    """name with as many leading underscores as make it differ from all taken ones, in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, so a lost executor costs no rerun."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Of a table's partitions; a key with more than so small a part of one is frequent.
FREQUENT = 8


def joined_by_frequency(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with side, which has each value of keys once and tells in count how often it stands among all `total` rows.

    Frequent values of side are broadcast, fewer than FREQUENT for each shuffle partition whatever the table, so their rows stay
    where they are; only the others are shuffled, and none of those is a large part of a task. rows is read twice.
    """
    limit = total // (FREQUENT * shuffle_partitions(rows.sparkSession))
    own, told = [c for c in rows.columns if c not in keys], [c for c in side.columns if c not in keys]
    mark = fresh_name("frequent", rows.columns)
    frequent = side.where(F.col(count) > limit).select(*keys, F.struct(*told).alias(mark))
    marked = rows.join(F.broadcast(frequent), keys, "left")
    here = marked.where(F.col(mark).isNotNull()).select(*keys, *own, f"{mark}.*")
    return here.unionByName(marked.where(F.col(mark).isNull()).drop(mark).join(side.where(F.col(count) <= limit), keys))


def splitters(keys: DataFrame, key: str, rows: int, buckets: int, per_bucket: int = 20) -> list[str]:
    """At most buckets - 1 ascending splitters of a string key of bounded width, from a sample of about per_bucket keys a bucket.

    The sample is chosen by a hash of the key, so a rerun gets the same one. It grows with the number of buckets only.
    """
    if buckets < 2:
        return []
    share = min(1.0, per_bucket * buckets / max(rows, 1))
    modulus = 1 << 30
    sample = keys.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(modulus)) < int(share * modulus))
    ordered = sample.agg(F.sort_array(F.collect_list(key)).alias("k"))
    step = F.size("k") / F.lit(buckets)
    picked = ordered.select(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.try_element_at("k", F.floor(step * i).cast("int") + 1))).alias("s"))
    return sorted(x for x in picked.first().s if x is not None)


def range_bucket(key: Column, found: list[str]) -> Column:
    """The number of splitters at or below key, by a coarse and a fine search over constant arrays."""
    if not found:
        return F.lit(0)
    width = max(1, math.isqrt(len(found)))
    every = F.split(F.lit(",".join(found)), ",")
    coarse = F.split(F.lit(",".join(found[::width])), ",")
    block = F.greatest(F.size(F.filter(coarse, lambda s: s <= key)) - 1, F.lit(0))
    return (block * width + F.size(F.filter(F.slice(every, block * width + 1, width), lambda s: s <= key))).cast("int")
