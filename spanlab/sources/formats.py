"""`spark.read.format` for ground truth: spanlab_annotations, spanlab_queries and spanlab_evidence.

    formats.register(spark)
    spark.read.format("spanlab_evidence").option("part", "queries").load("/data/set.json")

A file is a partition. Files are opened by the tasks, so the path (a file, a folder or a pattern) has to be one that driver and
executors share; `gold` reads the same records from any store that Spark reaches. A broken file fails the read with a GoldError
that names the fault.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanlab.sources import records


@dataclass
class FilePartition(InputPartition):
    path: str


class FileReader(DataSourceReader):
    def __init__(self, path: str, ending: str, rows: Callable[[str, bytes], Iterator[tuple]]):
        self.path, self.ending, self.rows = path, ending, rows

    def partitions(self) -> list[FilePartition]:
        found = glob.glob(f"{self.path}/*{self.ending}") if os.path.isdir(self.path) else glob.glob(self.path)
        if not found:
            raise records.GoldError(f"no files at {self.path}")
        return [FilePartition(path) for path in sorted(found)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            yield from self.rows(partition.path, file.read())


class _Parted(DataSource):
    """Several kinds of records in one file; option part names the one to read."""

    kinds: dict[str, str]
    parse: Callable[[str, bytes], Iterator[tuple[str, tuple]]]

    @property
    def part(self) -> str:
        part = self.options.get("part", next(iter(self.kinds)))
        if part not in self.kinds:
            raise records.GoldError(f"part is one of {sorted(self.kinds)}")
        return part

    def schema(self) -> str:
        return self.kinds[self.part]

    def reader(self, schema) -> FileReader:
        part, parse = self.part, type(self).parse
        return FileReader(self.options["path"], ".json", lambda path, content: (row for kind, row in parse(path, content) if kind == part))


class AnnotationFiles(_Parted):
    kinds, parse = records.ANNOTATION, staticmethod(records.annotation_rows)

    @classmethod
    def name(cls) -> str:
        return "spanlab_annotations"


class EvidenceFiles(_Parted):
    kinds, parse = records.EVIDENCE, staticmethod(records.evidence_rows)

    @classmethod
    def name(cls) -> str:
        return "spanlab_evidence"


class QueryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spanlab_queries"

    def schema(self) -> str:
        return records.QUERY

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], ".yaml", records.query_rows)


def register(spark: SparkSession) -> None:
    for source in (AnnotationFiles, QueryFiles, EvidenceFiles):
        spark.dataSource.register(source)
