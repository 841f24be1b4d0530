"""Labelled datasets: question-answer contracts, labelled provisions, label maps, and small built-in providers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def span_contracts(rows: DataFrame) -> DataFrame:
    """rows: title, context, question, answers struct<answer_start, text>. One row for each title: its context, distinct spans
    whose slice is the answer, and the questions."""
    answers = F.filter(F.arrays_zip(F.col("answers.answer_start").alias("start"), F.col("answers.text").alias("text")), lambda a: F.substring(F.col("context"), a["start"] + 1, F.length(a["text"])) == a["text"])
    spans = F.transform(answers, lambda a: F.struct(a["start"].alias("start"), (a["start"] + F.length(a["text"])).alias("end")))
    one = rows.withColumn("_spans", spans)
    return one.groupBy(F.col("title").alias("contract_id")).agg(F.first("context").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_spans")))).alias("spans"), F.array_sort(F.collect_set("question")).alias("categories"))


def with_spans(contracts: DataFrame) -> DataFrame:
    return contracts.where(F.size("spans") > 0)


def labelled_split(spark: SparkSession, paths: list[str], names: list[str] | None = None) -> DataFrame:
    """The first of several Parquet sources that can be read: text, source_label. Whole-number labels are looked up in names."""
    problems = []
    for path in paths:
        try:
            rows = spark.read.parquet(path)
        except Exception as problem:  # noqa: BLE001  the next source is tried, all problems are told
            problems.append(f"{path}: {type(problem).__name__}")
            continue
        label: Column = F.col("label")
        if names is not None and dict(rows.dtypes)["label"] != "string":
            label = F.element_at(F.array(*map(F.lit, names)), F.col("label").cast("int") + 1)
        return rows.select("text", label.alias("source_label"))
    raise FileNotFoundError("; ".join(problems))


def label_map(spark: SparkSession, path: str, targets: set[str]) -> DataFrame:
    """YAML: label: {target, rationale}. Unknown targets and missing rationales are errors."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rows, wrong = [], []
    for label, entry in found.items():
        if not isinstance(entry, dict) or entry.get("target") not in targets | {"__out_of_scope__"} or not str(entry.get("rationale") or "").strip():
            wrong.append(label)
        else:
            rows.append((label, entry["target"], entry["rationale"]))
    if wrong:
        raise ValueError(f"label map entries are wrong: {sorted(wrong)[:20]}")
    return spark.createDataFrame(rows, "source_label string, target string, rationale string")


def smoke_provisions(spark: SparkSession) -> DataFrame:
    """A few labelled sentences of our own."""
    rows = [("The licensee pays each invoice within thirty days.", "payment"), ("Either side may end this contract on notice.", "termination"), ("Disputes go to the courts of the seller's seat.", "disputes"), ("Fees are due in advance and are not returned.", "payment"), ("This contract ends when the works are handed over.", "termination")]
    return spark.createDataFrame(rows, "text string, source_label string")
