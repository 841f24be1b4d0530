"""Ground truth: annotations, queries and anchored evidence, read strictly and checked."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.operators import validate
from spanlab.session import held
from spanlab.sources import records
from spanlab.sources.records import GoldError

# Kinds of references.
KINDS = ("internal_clause", "internal_schedule", "internal_definition", "external_statute", "external_document")


def _parsed(spark: SparkSession, paths: str | list[str], rows: Callable[[str, bytes], Iterator[tuple]], schema: str, pattern: str) -> DataFrame:
    """Rows of all files of a pattern, as Spark reads them from any store; files that break a rule are a GoldError."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found += [(*row, None) for row in rows(path, bytes(content))]
                except GoldError as problem:
                    found.append((*[None] * len(names), str(problem)))
            yield pd.DataFrame(found, columns=[*names, "problem"]).astype(object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths).select("path", "content")
    parsed = held(files.mapInPandas(run, f"{schema}, problem string"))
    problems = [r.problem for r in parsed.where("problem is not null").orderBy("problem").limit(validate.SHOWN).collect()]
    if problems:
        raise GoldError("; ".join(problems))
    return parsed.drop("problem")


def _parts(spark: SparkSession, paths: str | list[str], rows: Callable[[str, bytes], Iterator[tuple[str, tuple]]], kinds: dict[str, str]) -> dict[str, DataFrame]:
    """A frame for each kind of record: files are parsed once, to JSON of their records."""
    names = {part: [c.split()[0] for c in schema.split(", ")] for part, schema in kinds.items()}

    def told(path: str, content: bytes) -> Iterator[tuple]:
        for part, row in rows(path, content):
            yield part, json.dumps(dict(zip(names[part], row)))

    parsed = _parsed(spark, paths, told, "part string, record string", "*.json")
    return {part: parsed.where(F.col("part") == part).select(F.from_json("record", schema).alias("r")).select("r.*") for part, schema in kinds.items()}


def annotations(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """documents, clauses, terms and references of annotation files, or of all in a folder."""
    return _parts(spark, paths, records.annotation_rows, records.ANNOTATION)


def checked(gold: dict[str, DataFrame], docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """gold, after all rules held; raises with at most 20 violations. docs: document_id, text, sanitised."""
    found = validate.clause_violations(gold["clauses"]).unionByName(validate.term_violations(gold["terms"]))
    found = found.unionByName(validate.reference_violations(gold["references"], gold["clauses"], KINDS))
    if docs is not None:
        found = found.unionByName(validate.document_violations(gold["documents"], docs))
    validate.raise_if_any(found, GoldError)
    return gold


def queries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """YAML query files, or all in a folder: a row for each section that a query points to."""
    return _parsed(spark, paths, records.query_rows, records.QUERY, "*.yaml")


def resolved_queries(asked: DataFrame, clauses: DataFrame) -> DataFrame:
    """Sections of queries with the span of the clause's whole subtree; an identifier without a clause is an error."""
    lost = [(r.query_id, r.identifier) for r in asked.join(clauses, ["document_id", "identifier"], "left_anti").limit(20).collect()]
    if lost:
        raise GoldError(f"queries name unknown clauses: {lost}")
    spans_ = clauses.select("document_id", "identifier", "g_start", F.col("subtree_end").alias("g_end"))
    return asked.join(spans_, ["document_id", "identifier"]).withColumnRenamed("identifier", "section_id")


def evidence_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An anchored-evidence file and the texts in its folder: corpus, documents (with text), evidence, queries, answer_spans,
    all checked."""
    parts = _parts(spark, path, records.evidence_rows, records.EVIDENCE)
    folder = path.rpartition("/")[0]
    bare = re.sub(r"^[a-z]+:/*", "/", folder).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    place = F.expr(f"substring(path, locate('{bare}', path) + {len(bare)})")
    raw = raw.select(place.alias("path"), F.sha2("content", 256).alias("found"), F.col("content").cast("string").alias("text"))
    docs = held(parts["documents"].join(raw, "path", "left"))
    problem = F.when(F.col("found").isNull(), "file is missing").when(F.col("sha256") != F.col("found"), "has another SHA-256").when(~F.is_valid_utf8("text"), "must be UTF-8")
    validate.raise_if_any(docs.select("document_id", problem.alias("what")).where("what is not null"), GoldError)
    docs = docs.drop("found")
    validate.raise_if_any(validate.evidence_violations(docs, parts["evidence"], parts["queries"], parts["answer_spans"]), GoldError)
    return parts | {"documents": docs}
