"""Results: metric tables as Parquet, one nested JSON, self-hashing reports, Markdown and HTML, and reading them again."""

from __future__ import annotations

import hashlib
import html
import json
import math
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab import __version__
from spanlab.session import held

# The current and the superseded shape of a structural row.
CURRENT, LEGACY = "clause_fragmentation", "legacy_fragmentation"


def save_tables(tables: dict[str, DataFrame], folder: str, made: DataFrame | None = None) -> None:
    """The primary form: one Parquet table for each name; chunk tables are partitioned by strategy. made, a `manifest`, says
    beside them how they were made; it is written last, so a folder without one isn't complete."""
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("strategy") if name == "chunk" else writer).parquet(f"{folder}/{name}")
    if made is not None:
        made.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def append_cache(rows: DataFrame, folder: str) -> None:
    """New vectors (model, text_key, vec) to the embedding cache."""
    rows.select("model", "text_key", "vec").write.mode("append").partitionBy("model").parquet(folder)


def plain(x):
    """For JSON: sets sorted, not-a-number and infinities as text."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted(map(plain, x), key=str)
    if isinstance(x, (list, tuple)):
        return [*map(plain, x)]
    if isinstance(x, float) and not math.isfinite(x):
        return str(x)
    return x.item() if hasattr(x, "item") else x


def canonical(content: dict) -> str:
    return json.dumps(plain(content), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hashed_report(content: dict) -> dict:
    """content with the SHA-256 of its canonical form."""
    return content | {"report_sha256": hashlib.sha256(canonical(content).encode()).hexdigest()}


def verified(report: dict) -> bool:
    return hashed_report({k: v for k, v in report.items() if k != "report_sha256"})["report_sha256"] == report.get("report_sha256")


def export_json(tables: dict[str, DataFrame], path: str, **provenance) -> None:
    """Aggregated metric tables only, which the driver can hold."""
    content = provenance | {name: [r.asDict(recursive=True) for r in rows.collect()] for name, rows in tables.items()}
    Path(path).write_text(json.dumps(plain(content), indent=2, ensure_ascii=False), encoding="utf-8")


def read_structural(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the current and of the superseded shape from JSON lines; malformed ones are skipped."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    for c in (CURRENT, LEGACY, "_corrupt_record"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string" if c == "_corrupt_record" else "double"))
    rows = held(rows).where("_corrupt_record is null").drop("_corrupt_record")
    return rows.where(F.col(CURRENT).isNotNull()).drop(LEGACY), rows.where(F.col(LEGACY).isNotNull() & F.col(CURRENT).isNull()).drop(CURRENT)


def cell(x, places: int = 3) -> str:
    if x is None:
        return "n/a"
    if isinstance(x, float):
        return "n/a" if math.isnan(x) else ("∞" if x > 0 else "-∞") if math.isinf(x) else f"{x:.{places}f}"
    return str(x)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def replaced(document: str, name: str, content: str) -> str:
    """document with what stands between the markers of name replaced."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if start not in document or end not in document:
        raise ValueError(f"markers of {name} are missing")
    return document[: document.index(start) + len(start)] + f"\n{content}\n" + document[document.index(end) :]


def stale(document: str, name: str, content: str) -> bool:
    return replaced(document, name, content) != document


PAGE = Template("<!doctype html><meta charset='utf-8'><title>$title</title><h1>$title</h1>$body")


def html_report(title: str, tables: dict[str, list[dict]]) -> str:
    body = ""
    for name, rows in tables.items():
        columns = list(rows[0]) if rows else []
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        body += f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(cell(r[c]))}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"
    return PAGE.substitute(title=html.escape(title), body=body)


def tree_sha256(folder: str) -> str:
    """Of a package's Python files, names and contents."""
    digest = hashlib.sha256()
    for path in sorted(Path(folder).rglob("*.py")):
        digest.update(str(path.relative_to(folder)).encode() + b"\0" + path.read_bytes() + b"\0")
    return digest.hexdigest()


def commit(folder: str) -> str | None:
    """The commit that a repository's folder stands at, as its files tell it."""
    git = Path(folder) / ".git"
    if not (git / "HEAD").is_file():
        return None
    head = (git / "HEAD").read_text().strip()
    if not head.startswith("ref: "):
        return head
    name = head.removeprefix("ref: ")
    if (git / name).is_file():
        return (git / name).read_text().strip()
    packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").is_file() else []
    return next((line.split()[0] for line in packed if line.endswith(f" {name}")), None)


def manifest(spark: SparkSession, config: dict, seed: int, corpus: dict | None = None) -> DataFrame:
    """One row that says how a run was made."""
    package = Path(__file__).resolve().parents[1]
    row = [(canonical(config), int(seed), canonical(corpus or {}), __version__, commit(str(package.parent)), tree_sha256(str(package)), spark.version)]
    kinds = "config string, seed long, corpus string, version string, commit string, package_sha256 string, spark_version string"
    return spark.createDataFrame(row, kinds).withColumn("created", F.current_timestamp())
