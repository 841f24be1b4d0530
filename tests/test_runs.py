"""Runs as nested documents: round trips, both structural shapes, malformed entries told apart."""

import json
import math

import pytest
from pyspark.sql import functions as F

from spanlab.operators import clause_aware as A, extract, retrieval as R, stats as ST, structural as S
from spanlab.sources import runs
from tests.test_clause_aware import UK


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def parts(spark):
    """Tables of the operators themselves."""
    docs = spark.createDataFrame([("d", UK, "uk_decimal")], "document_id string, text string, numbering_style string")
    chunks = A.clause_aware(docs, 1, 1200).withColumns({"strategy": F.lit("clause_aware"), "char_count": F.length("text")})
    found = extract.extracted(docs)
    clauses = extract.clause_table(found)
    from spanlab.operators.spans import leaves, subtree_ends

    clauses = subtree_ends(clauses).join(leaves(clauses).select("document_id", "identifier", F.lit(True).alias("is_leaf")), ["document_id", "identifier"], "left").fillna(False, ["is_leaf"])
    structural = S.structural_row(chunks, clauses, docs, extract.term_table(docs), extract.reference_table(found))
    hits = spark.createDataFrame([(1, 1, 1, "a", "d", 0, 200)], "query_id int, rank int, ord int, chunk_id string, document_id string, char_start int, char_end int")
    sections = spark.createDataFrame([(1, "d", "s", 0, 150, 3, 0)], "query_id int, document_id string, section_id string, g_start int, g_end int, grade int, ord int")
    retrieval = R.metrics(hits.select("query_id"), hits, sections).withColumns({"strategy": F.lit("x"), "model": F.lit("m"), "ndcg_metric": F.lit(runs.NDCG_METRIC)})
    diffs = spark.range(12).select(F.lit("m").alias("model"), F.lit("mrr").alias("metric"), F.lit("x").alias("strategy_a"), F.lit("y").alias("strategy_b"), F.col("id").cast("string").alias("query_id"), (F.col("id") / 12).alias("a"), F.lit(0.25).alias("b"), (F.col("id") / 12 - 0.25).alias("diff"))
    matrix = ST.comparison_matrix(diffs, 20).withColumn("n_documents", F.col("n"))
    return {"structural_metrics": structural, "retrieval_metrics": retrieval, "comparisons": matrix, "significance_results": ST.uncorrected(diffs)}


def test_round_trip(spark, parts, tmp_path):
    folder = str(tmp_path / "run")
    runs.export(spark, parts, folder, seed=7, strategies=["x", "y"], models=["m"], documents=["d"], timestamp="now", config={"top_k": 10})
    back = runs.read(spark, folder)
    for part, given in parts.items():
        want = rows(runs.entries(given, part))
        got = rows(back[part].drop("run"))
        assert len(got) == len(want) == 1
        assert all(a == b or (isinstance(b, float) and math.isclose(a, b)) for a, b in zip(got[0], want[0])), part
        assert [f.dataType for f in back[part].drop("run").schema] == [f.dataType for f in runs.entries(given, part).schema]
    assert back["skipped"].count() == back["legacy_structural_metrics"].count() == 0
    head = back["runs"].first()
    assert (head.seed, head.strategies, head.documents, json.loads(head.config)) == (7, ["x", "y"], ["d"], {"top_k": "10"})
    row = back["structural_metrics"].first()
    assert row.n_leaf_clauses == 4 and row.n_top_level_clauses == 3 and row.located_chunks == 9 and row.heading_recall == 1.0


STRUCTURAL = {
    "strategy": "s", "document_id": "d", "chunk_count": 3, "avg_chunk_chars": 9.5, "chunk_size_cv": 0, "located_chunks": 3, "localization_rate": 1.0,
    "localization_coverage": 1, "n_leaf_clauses": 2, "clause_fragmentation_rate": 0.5, "n_top_level_clauses": 1, "top_level_over_merge_rate": 0.0,
    "sub_clause_grouping_rate": 0.0, "n_gold_headings": 2, "n_definition_uses": 0, "definition_attachment_recall": 1.0, "n_gold_cross_refs": 0,
}
LEGACY = {
    "strategy": "s", "document_id": "d", "clause_fragmentation_rate": 0.1, "definition_preservation_rate": 1.0, "cross_ref_resolution_rate": 0.2,
    "hierarchy_depth_retained": 1.0, "chunk_size_cv": 0.3, "chunk_count": 4, "avg_chunk_chars": 10.0,
}
RETRIEVAL = {"query_id": "q", "strategy": "s", "embedding_model": "m", **{f"{n}_at_{k}": 0.5 for n in ("precision", "recall") for k in (1, 3, 5, 10)}, "mrr": 1.0, "ndcg_at_10": 0.9, "drm_hit": False}


def without(entry, *names):
    return {k: v for k, v in entry.items() if k not in names}


def test_shapes_and_malformed_entries(spark, tmp_path):
    comparison = {name: {"string": "x", "bigint": 1, "double": 0.5, "boolean": True}[kind] for name, kind, _, _ in runs.fields("comparisons")}
    content = {
        "timestamp": "t",
        "structural_metrics": [STRUCTURAL, LEGACY, without(STRUCTURAL, "chunk_count"), STRUCTURAL | {"localization_rate": "high"}, 7, STRUCTURAL | {"heading_recall": 0.25, "chunk_size_cv": None}],
        "legacy_structural_metrics": [LEGACY | {"chunk_count": 5}, without(LEGACY, "strategy")],
        "retrieval_metrics": [RETRIEVAL, RETRIEVAL | {"ndcg_metric": "v9", "drm_rate": 0.3, "n_relevant_sections": 2}, without(RETRIEVAL, "mrr")],
        "comparisons": [comparison, comparison | {"delta": None}, comparison | {"ci_low": "NaN"}],
        "significance_results": {"not": "a list"},
        "something_else": [1],
    }
    path = tmp_path / "run.json"
    path.write_text(json.dumps(content, indent=1))
    back = runs.read(spark, str(path))
    assert [(r.chunk_count, r.heading_recall, r.chunk_size_cv) for r in back["structural_metrics"].orderBy(F.desc("chunk_size_cv")).collect()] == [(3, None, 0.0), (3, 0.25, None)]
    assert sorted(r.chunk_count for r in back["legacy_structural_metrics"].collect()) == [4, 5]
    assert sorted((r.ndcg_metric, r.drm_rate, r.n_relevant_sections) for r in back["retrieval_metrics"].collect()) == [("legacy_unversioned", 0.0, 0), ("v9", 0.3, 2)]
    low = sorted((r.ci_low for r in back["comparisons"].collect()), key=math.isnan)
    assert low[0] == 0.5 and math.isnan(low[1])
    assert back["significance_results"].count() == 0
    assert rows(back["skipped"].drop("run")) == sorted([
        ("structural_metrics", 2, "chunk_count is missing"), ("structural_metrics", 3, "localization_rate isn't double"), ("structural_metrics", 4, "strategy is missing"),
        ("legacy_structural_metrics", 1, "strategy is missing"), ("retrieval_metrics", 2, "mrr is missing"), ("comparisons", 1, "delta is null"),
    ], key=str)


def test_several_runs_and_files_that_are_none(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"structural_metrics": [STRUCTURAL], "seed": 3}))
    back = runs.read(spark, str(tmp_path))
    assert back["runs"].count() == 2 and back["structural_metrics"].select("run").distinct().count() == 2
    for text in ("[1, 2]", "{"):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(runs.RunError, match="c.json"):
            runs.read(spark, str(tmp_path))
    with pytest.raises(runs.RunError, match="unknown parts"):
        runs.nested(spark, {"other": back["runs"]})
