"""A run as one nested JSON document: written by Spark from metric tables, and read back to typed tables.

Parquet tables are the primary form of results; this one is for readers that want a run in one piece. Reading goes through
VARIANT: entries are exploded from the arrays of a document and their fields are taken by type, so one malformed entry doesn't
spoil the others. It is left out and told in `skipped`, with the field that is missing or of another type. Structural entries
of the superseded shape are known by fields that only it has, and go to a table of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RunError(ValueError):
    """A file isn't a run."""


# The arrays of a run and the fields of their entries. A field with "?" may be missing or null, one with "=" has
# a default. Values of the others may be null only in the arrays named in NULLABLE.
ENTRIES: dict[str, str] = {
    "structural_metrics": """strategy string, document_id string, chunk_count bigint, avg_chunk_chars double, chunk_size_cv double, located_chunks bigint,
        localization_rate double, localization_coverage double, n_leaf_clauses bigint, clause_fragmentation_rate double, n_top_level_clauses bigint,
        top_level_over_merge_rate double, sub_clause_grouping_rate double, heading_recall? double, heading_precision? double, n_gold_headings bigint,
        n_definition_uses bigint, definition_attachment_recall double, n_gold_cross_refs bigint, xref_target_recall? double, xref_target_precision? double""",
    "legacy_structural_metrics": """strategy string, document_id string, clause_fragmentation_rate double, definition_preservation_rate double,
        cross_ref_resolution_rate double, hierarchy_depth_retained double, chunk_size_cv double, chunk_count bigint, avg_chunk_chars double""",
    "retrieval_metrics": """query_id string, strategy string, embedding_model string, precision_at_1 double, precision_at_3 double, precision_at_5 double,
        precision_at_10 double, recall_at_1 double, recall_at_3 double, recall_at_5 double, recall_at_10 double, mrr double, ndcg_at_10 double,
        ndcg_metric=legacy_unversioned string, drm_hit boolean, drm_rate=0 double, n_relevant_sections=0 bigint""",
    "comparisons": """metric_name string, strategy_a string, strategy_b string, embedding_model string, n bigint, mean_a double, mean_b double, delta double,
        ci_low double, ci_high double, t_statistic double, p_value_t double, p_value_wilcoxon double, p_value_holm double, significant_holm boolean,
        cohens_d double, rank_biserial double, n_documents bigint, lodo_min_delta double, lodo_max_delta double, lodo_worst_document string""",
    "significance_results": """metric_name string, strategy_a string, strategy_b string, mean_a double, mean_b double, improvement_pct double,
        t_statistic double, p_value double, significant boolean, effect_size double, n_queries bigint""",
}
NULLABLE = ("structural_metrics", "legacy_structural_metrics", "retrieval_metrics", "significance_results")
LEGACY_MARKS = ("definition_preservation_rate", "cross_ref_resolution_rate", "hierarchy_depth_retained")
HEAD = "timestamp string, seed bigint, strategies array<string>, models array<string>, documents array<string>"
#: How the operators' columns are called in a run.
NAMES = {
    "structural_metrics": {
        "n_chunks": "chunk_count", "avg_chunk_size": "avg_chunk_chars", "size_cv": "chunk_size_cv", "clause_fragmentation": "clause_fragmentation_rate",
        "top_level_over_merge": "top_level_over_merge_rate", "sub_clause_grouping": "sub_clause_grouping_rate",
        "definition_attachment": "definition_attachment_recall", "xref_recall": "xref_target_recall", "xref_precision": "xref_target_precision",
    },
    "retrieval_metrics": {"model": "embedding_model", "drm": "drm_rate", "total_relevant": "n_relevant_sections"},
    "comparisons": {
        "metric": "metric_name", "model": "embedding_model", "mean_diff": "delta", "low": "ci_low", "high": "ci_high", "t": "t_statistic", "p_t": "p_value_t",
        "p_wilcoxon": "p_value_wilcoxon", "p_holm": "p_value_holm", "significant": "significant_holm", "lodo_min": "lodo_min_delta",
        "lodo_max": "lodo_max_delta", "lodo_worst": "lodo_worst_document",
    },
    "significance_results": {"metric": "metric_name", "p": "p_value", "cohens_d": "effect_size", "n": "n_queries"},
}
#: The version of NDCG that runs of this package have.
NDCG_METRIC = "assignment_v1"


def fields(part: str) -> list[tuple[str, str, str | None, bool]]:
    """(name, type, default, optional) of each field of a part's entries."""
    out = []
    for one in ENTRIES[part].split(","):
        told, kind = one.split()
        name, _, default = told.rstrip("?").partition("=")
        out.append((name, kind, default or None, told.endswith("?")))
    return out


def entries(rows: DataFrame, part: str) -> DataFrame:
    """rows of an operator with the names, types and order of a part's entries; fields that it doesn't have are null."""
    rows = rows.withColumnsRenamed({old: new for old, new in NAMES.get(part, {}).items() if old in rows.columns and new not in rows.columns})
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind, _, _ in fields(part)])


def nested(spark: SparkSession, parts: dict[str, DataFrame], **head) -> DataFrame:
    """One row, value: the JSON of a run with the entries of parts in the order of their fields. head: timestamp, seed, strategies,
    models, documents and config."""
    if unknown := set(parts) - set(ENTRIES):
        raise RunError(f"unknown parts: {sorted(unknown)}")
    known = json.dumps({k: head.get(k) for k in ("timestamp", "seed", "strategies", "models", "documents")})
    run = spark.range(1).select(F.from_json(F.lit(known), HEAD).alias("head"), F.lit(json.dumps(head.get("config") or {}, sort_keys=True)).alias("config"))
    for part in ENTRIES:
        if part in parts:
            rows = entries(parts[part], part)
            one = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(part))  # one row
            run = run.crossJoin(F.broadcast(one))
    body = F.struct("head.*", F.from_json("config", "map<string,string>").alias("config"), *[p for p in ENTRIES if p in parts])
    return run.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def export(spark: SparkSession, parts: dict[str, DataFrame], folder: str, **head) -> None:
    """Writes a run to a folder of any store."""
    nested(spark, parts, **head).coalesce(1).write.mode("overwrite").text(folder)


def _field(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _read(found: DataFrame, part: str) -> DataFrame:
    """found: run, array, position, value. run, the part's fields, position, and problem: the first field that is wrong."""
    value = F.col("value")
    problem = F.lit(None).cast("string")
    columns = []
    for name, kind, default, optional in reversed(fields(part)):
        raw, typed = F.try_variant_get(value, f"$.{name}", "variant"), _field(value, name, kind)
        null = F.coalesce(F.is_variant_null(raw), F.lit(False))
        wrong = F.when(~null & raw.isNotNull() & typed.isNull(), f"{name} isn't {kind}")
        if not optional and default is None:
            wrong = F.when(raw.isNull(), f"{name} is missing").when(null & F.lit(part not in NULLABLE), f"{name} is null").otherwise(wrong)
        problem = F.coalesce(wrong, problem)
        columns.append((typed if default is None else F.coalesce(typed, F.lit(default).cast(kind))).alias(name))
    return found.select("run", "array", "position", *columns[::-1], problem.alias("problem"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Runs at a path (a file or folder): runs (one row each), a table for each part, and skipped (run, part, position, problem)."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.input_file_name().alias("run"), F.try_parse_json("value").alias("v"))
    broken = [r.run for r in whole.where("v IS NULL OR NOT schema_of_variant(v) LIKE 'OBJECT%'").select("run").limit(20).collect()]
    if broken:
        raise RunError(f"not runs: {broken}")
    head = [_field(F.col("v"), name, kind).alias(name) for name, kind in (x.split() for x in HEAD.split(", "))]
    out = {"runs": whole.select("run", *head, F.to_json(F.try_variant_get("v", "$.config", "variant")).alias("config"))}
    each = {}
    for array in ENTRIES:
        held = whole.select("run", F.try_variant_get("v", f"$.{array}", "variant").alias("all")).where("schema_of_variant(all) LIKE 'ARRAY%'")
        exploded = spark.sql("SELECT run, pos AS position, value FROM {held}, LATERAL variant_explode(all)", held=held)
        each[array] = exploded.withColumn("array", F.lit(array))
    mark = F.lit(False)
    for name in LEGACY_MARKS:
        mark = mark | F.try_variant_get("value", f"$.{name}", "variant").isNotNull()
    structural = each["structural_metrics"]
    each["structural_metrics"] = structural.where(~mark)
    each["legacy_structural_metrics"] = each["legacy_structural_metrics"].unionByName(structural.where(mark))
    skipped = None
    for part, found in each.items():
        typed = _read(found, part)
        wrong = typed.where("problem IS NOT NULL").select("run", F.col("array").alias("part"), "position", "problem")
        skipped = wrong if skipped is None else skipped.unionByName(wrong)
        out[part] = typed.where("problem IS NULL").drop("problem", "array", "position")
    return out | {"skipped": skipped}
