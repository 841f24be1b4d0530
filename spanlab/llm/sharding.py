"""Sharding by size-tiered compaction, in DataFrame functions only.

A store is a folder: immutable Parquet shards, manifests (tables with a row for each shard) and versions. `append` writes
arrivals as small shards, one task writing a few of them without any shuffle. `compact` puts the shards below half the
target size into tiers by the logarithm of their size, cuts each tier's shards in size order into groups of like size,
about the target, and merges each group into one file. A version is a small file that names its manifest and schema. After
the manifest and all shards it is written under a name of its own, closed, and then renamed to the version's without
overwriting, which one writer alone can do for a version and which is atomic on HDFS (a local disk checks first). So readers
see a whole version or the one before, and a writer that dies leaves only files that no version names; a version's file that
can't be read, as from a disk that lost it, is passed over by readers and deleted by `recover`. Older versions stay readable
until `vacuum` deletes them and the shards that only they name.

Plan at scale: a round of `compact` takes `round_files` shards at most, so the file names that come to the driver (Spark
wants them there to read) are bounded, and rounds repeat until no tier is due. Each group goes to a task of its own.
Readers name folders; only where some of a folder's shards are dead are the live ones named, up to `round_files`. Beyond,
the folder is read whole and its dead shards' rows are dropped by the join with the manifest.

Defined cases: rows are kept as they are, nulls, repeated rows and all columns included, whatever their names; where a
column has the name of one that `read` adds, the added one gets underscores in front. An empty table appends no shard, and
a store without shards reads as an empty table of its schema; one without any version raises FileNotFoundError. A shard
larger than half the target is left alone.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanlab.llm._common import fresh_name, fresh_path
from spanlab.operators import ranges

MANIFEST = "shard string, path string, folder string, siblings bigint, bytes bigint, rows bigint, tier int, born int"
#: A broadcast of the file-to-group map is used below this many files, a shuffled join beyond.
BROADCAST_FILES = 200_000
#: A shard counts as full from this share of the target size, as a merged file is rarely exactly as large as its parts.
FULL = 0.5
#: So many shards of a tier are put in order by one task.
LANE_SHARDS = 100_000


class ConflictError(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fanout: int = 4, shard_rows: int = 4096, round_files: int = 100_000):
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.shard_rows, self.round_files = shard_rows, round_files
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._fs_path("/".join([self.root, *parts]))

    def _version_file(self, version: int):
        return self._path("versions", f"v{version:08d}")

    def _listed_versions(self) -> list[int]:
        """Numbers of all versions' files, the newest first."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path("versions"))]
        return sorted((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), reverse=True)

    def version(self) -> int:
        """The newest committed version; 0 where there is none."""
        return next((v for v in self._listed_versions() if self._told(v)), 0)

    def _told(self, version: int) -> dict | None:
        """What a version's file says; null if that isn't all of a version."""
        stream = self.fs.open(self._version_file(version))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()
        return told if isinstance(told, dict) and {"manifest", "schema"} <= set(told) else None

    def schema(self, version: int | None = None) -> StructType | None:
        """Of the rows; None before the first version."""
        version = self.version() if version is None else version
        return StructType.fromJson(self._told(version)["schema"]) if version else None

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._told(version)['manifest']}")

    def _commit(self, shards: DataFrame, after: int, schema: StructType | None = None) -> int:
        """Writes the manifest, then creates the version's file, which fails if the version exists."""
        schema = schema or self.schema()
        name = uuid.uuid4().hex
        shards.select(*[f.name for f in self.manifest(0).schema]).write.parquet(f"{self.root}/manifests/{name}")
        self.fs.mkdirs(self._path("versions"))
        draft = self._path("versions", f"draft-{name}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
        target = self._version_file(after + 1)
        try:
            files.rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), plain)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(target):
                raise ConflictError(f"version {after + 1} exists") from e
            raise
        return after + 1

    def recover(self) -> None:
        """Deletes what writers that died left among the versions: drafts, and files that don't hold a version. For when no
        writer is at work."""
        for v in self._listed_versions():
            if not self._told(v):
                self.fs.delete(self._version_file(v), False)
        for x in self.fs.listStatus(self._path("versions")) if self.fs.exists(self._path("versions")) else []:
            if x.getPath().getName().startswith("draft-"):
                self.fs.delete(x.getPath(), False)

    def _rows(self, paths: list[str], schema: StructType) -> tuple[DataFrame, Column, Column]:
        """The rows of files or folders, and the path and size of the file that each is in."""
        # Without looking for partition columns: folders of groups and arrivals mean nothing.
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        file = rows.metadataColumn("_metadata")
        return rows, file.getField("file_path"), file.getField("file_size")

    def _listed(self, folder: str, version: int, schema: StructType) -> DataFrame:
        """The shards of a folder of data files, as manifest rows."""
        rows, path, size = self._rows([folder], schema)
        files = rows.select(path.alias("path"), size.cast("long").alias("bytes")).groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        steps = F.floor(F.log(F.col("bytes") / F.lit(self.target_bytes / self.fanout**8)) / F.lit(math.log(self.fanout)))
        siblings = files.agg(F.count(F.lit(1)).alias("siblings"))  # one row
        files = files.withColumn("folder", F.lit(folder)).crossJoin(F.broadcast(siblings))
        shard = F.substring(F.sha2("path", 256), 1, 16)
        return files.select(shard.alias("shard"), "path", "folder", "siblings", "bytes", "rows", F.greatest(F.lit(0), steps).cast("int").alias("tier"), F.lit(version).alias("born"))

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Adds rows as small immutable shards. With a column, each of its values is a run of shards of its own."""
        after = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        known = self.schema(after)
        if known is not None and known.simpleString() != rows.schema.simpleString():
            raise ValueError("the store holds rows of another schema")
        writer = rows
        if arrival is not None:
            run = fresh_name("arrival", rows.columns)
            writer = rows.withColumn(run, arrival)
        writer = writer.write.option("compression", "zstd").option("maxRecordsPerFile", self.shard_rows)
        (writer if arrival is None else writer.partitionBy(run)).parquet(folder)
        shards = self.manifest(after)
        if self._has_files(folder):
            shards = shards.unionByName(self._listed(folder, after + 1, rows.schema))
        return self._commit(shards, after, rows.schema)

    def _has_files(self, folder: str) -> bool:
        if not self.fs.exists(self._fs_path(folder)):
            return False
        found = self.fs.listFiles(self._fs_path(folder), True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def planned(self, version: int) -> DataFrame:
        """The shards to merge with the number of their group: path, merge_group (from 0).

        In each tier the shards in size order are cut into groups of like size, as many as the tier holds targets. A group is
        merged once it is full or has as many runs as the fan-out. A tier of very many shards is dealt into lanes first.
        """
        small = self.manifest(version).where(F.col("bytes") < FULL * self.target_bytes)
        lanes = -(-small.count() // LANE_SHARDS) or 1
        small = small.withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)))
        lane = Window.partitionBy("tier", "lane")
        order = lane.orderBy("bytes", "shard").rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("bytes").over(lane)
        groups = F.greatest(F.lit(1), F.round(total / self.target_bytes))
        # A shard belongs where its middle lies.
        middle = F.sum("bytes").over(order) - F.col("bytes") / 2
        small = small.withColumn("group", F.least(groups - 1, F.floor(middle * groups / total)).cast("int"))
        group = Window.partitionBy("tier", "lane", "group")
        due = (F.sum("bytes").over(group) >= FULL * self.target_bytes) | (F.count(F.lit(1)).over(group) >= self.fanout)
        due = due & (F.count(F.lit(1)).over(group) > 1)
        small = small.withColumn("due", due).where("due")
        names = small.select("tier", "lane", "group").distinct()
        # Whole groups, as many as a round may take files.
        sizes = small.groupBy("tier", "lane", "group").agg(F.count(F.lit(1)).alias("n"))
        # Groups in the order of tier, lane and group as one number, summed by ranges.
        place = F.col("tier") * F.lit(float(1 << 44)) + F.col("lane") * F.lit(float(1 << 24)) + F.col("group")
        placed = ranges.before(ranges.dealt(sizes.withColumn("place", place), [], "place"), [], "place", before=("sum", "n"), merge_group=("sum", F.lit(1)))
        taken = placed.withColumns({"files": F.col("before") + F.col("n"), "merge_group": F.col("merge_group").cast("int")})
        taken = taken.where((F.col("files") <= self.round_files) | (F.col("merge_group") == 0))
        return small.join(taken.select(*names.columns, "merge_group"), names.columns).select("path", "merge_group")

    def compact(self) -> int:
        """One round of merges; commits a version only if there was something to merge."""
        after = self.version()
        plan = self.planned(after).cache()
        try:
            paths = [r.path for r in plan.select("path").toLocalIterator()]  # round_files at most
            if not paths:
                return after
            schema = self.schema(after)
            groups = plan.agg(F.max("merge_group")).first()[0] + 1
            file, dealt, group = (fresh_name(n, schema.names) for n in ("file", "dealt", "merge_group"))
            rows, path, _ = self._rows(paths, schema)
            # Group numbers give way to numbers that hash to partitions of their own, so that no two groups meet in a task.
            numbers = self.spark.range(groups * (16 + math.ceil(math.log(groups + 1)))).withColumn("part", F.pmod(F.hash("id"), F.lit(groups)))
            numbers = numbers.groupBy("part").agg(F.min("id").alias(dealt)).withColumnRenamed("part", "merge_group")
            side = plan.join(F.broadcast(numbers), "merge_group", "left").select(F.col("path").alias(file), F.coalesce(dealt, F.col("merge_group").cast("long")).alias(dealt), F.col("merge_group").alias(group))
            rows = rows.select(*[rows[c] for c in schema.names], path.alias(file))
            rows = rows.join(F.broadcast(side) if len(paths) <= BROADCAST_FILES else side, file).drop(file)
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            merged = rows.repartition(groups, dealt).drop(dealt)
            merged.write.option("compression", "zstd").partitionBy(group).parquet(folder)
            left = self.manifest(after).join(plan, "path", "left_anti")
            return self._commit(left.unionByName(self._listed(folder, after + 1, schema)), after, schema)
        finally:
            plan.unpersist()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the newest `keep`, and the files that only those name."""
        versions = sorted(v for v in self._listed_versions() if self._told(v))
        old, kept = versions[:-keep], versions[-keep:]
        if not old:
            return
        named = lambda vs: reduce(DataFrame.union, [self.manifest(v).select("path") for v in vs])
        for r in named(old).distinct().join(named(kept), "path", "left_anti").toLocalIterator():
            self.fs.delete(self._fs_path(r.path), False)
        for v in old:
            manifest = self._told(v)["manifest"]
            self.fs.delete(self._version_file(v), False)
            self.fs.delete(self._path("manifests", manifest), True)

    def read(self, columns: list[str], version: int | None = None) -> DataFrame:
        """The rows of a version (the newest), with shard, shard_bytes, shard_rows, tier and version."""
        now = self.version() if version is None else version
        if not now:
            raise FileNotFoundError("the store has no version")
        schema = StructType([self.schema(now)[c] for c in columns])
        manifest = self.manifest(now)
        added = {n: fresh_name(n, columns) for n in ("shard", "shard_bytes", "shard_rows", "tier", "version")}
        folders = manifest.groupBy("folder").agg(F.count(F.lit(1)).alias("live"), F.max("siblings").alias("all")).collect()  # a row for each commit
        partly, named = [], 0
        for r in sorted((r for r in folders if r.live < r.all), key=lambda r: r.live):
            if named + r.live <= self.round_files:
                partly.append(r.folder)
                named += r.live
        whole = [r.folder for r in folders if r.folder not in partly]
        files = [r.path for r in manifest.where(F.col("folder").isin(partly)).select("path").toLocalIterator()] if partly else []
        side = manifest.select("path", "shard", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "tier", F.lit(now).alias("version"))
        if not folders:
            empty = self.spark.createDataFrame([], schema)
            return empty.select(*columns, *[F.lit(None).cast(side.schema[n].dataType).alias(a) for n, a in added.items()])
        file = fresh_name("file", [*columns, *added.values()])
        side = side.select(F.col("path").alias(file), *[F.col(n).alias(a) for n, a in added.items()])
        # The join drops the rows of dead files in folders that are read whole.
        out = None
        for paths in [x for x in (whole, files) if x]:
            rows, path, _ = self._rows(paths, schema)
            rows = rows.select(*[rows[c] for c in columns], path.alias(file))
            out = rows if out is None else out.unionByName(rows)
        few = manifest.count() <= BROADCAST_FILES
        return out.join(F.broadcast(side) if few else side, file).drop(file)


def sharded(docs: DataFrame, root: str | None = None, arrivals: int = 4, id_col: str = "doc_id", **how) -> ShardStore:
    """A store into which docs came as several arrivals, compacted until no tier is due. All versions stay."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or fresh_path(spark, "shards"), **how)
    store.append(docs, F.pmod(F.xxhash64(docs[id_col]), F.lit(arrivals)).cast("int"))
    while True:
        before = store.version()
        if store.compact() == before:
            return store
