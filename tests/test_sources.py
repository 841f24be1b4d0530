"""Readers of ground truth: records and errors by hand, through functions and through spark.read.format."""

import hashlib
import json

import pytest
from pyspark.errors import PythonException

from spanlab.operators import extract, spans
from spanlab.sources import formats, gold, records
from spanlab.sources.records import GoldError

TEXT = "1. Fees\n\n1.1 The buyer pays “ten”, see clause 1.\n"
DEED = TEXT.encode()


@pytest.fixture
def annotation():
    return {
        "document_id": "deed", "source_file": "deed.txt", "text_sha256": hashlib.sha256(DEED).hexdigest(), "n_chars": len(TEXT), "numbering_style": "uk_decimal",
        "clauses": [
            {"identifier": "1", "level": 1, "parent": None, "char_start": 0, "char_end": 9, "is_top_level": True, "heading": "Fees"},
            {"identifier": "1.1", "level": 2, "parent": "1", "char_start": 9, "char_end": len(TEXT), "is_top_level": False, "heading": None},
        ],
        "defined_terms": [{"term": "ten", "definition_span": [9, 30]}],
        "cross_references": [{"raw_text": "1", "char_start": TEXT.index("clause 1") + 7, "target_identifier": "1", "kind": "internal_clause"}],
    }


@pytest.fixture
def evidence():
    start = TEXT.index("The buyer")
    span = {"document_id": "deed", "start": start, "end": start + 14, "text": TEXT[start : start + 14]}
    return {
        "schema_version": "anchored_evidence_v1",
        "corpus": {"id": "c", "title": "t", "description": "d", "authorship": "mixed", "legal_validation": "unknown", "held_out": True, "customer_proof": False},
        "documents": [{
            "id": "deed", "path": "texts/deed.txt", "sha256": hashlib.sha256(DEED).hexdigest(), "jurisdiction": "uk", "license_status": "unknown",
            "license_identifier": "none", "review_status": "unknown", "provenance": {"kind": "synthetic", "source_url": None},
        }],
        "evidence": [{"id": "e1", "grade": 3, **span}],
        "queries": [
            {"id": "q1", "text": "Who pays?", "answerable": True, "evidence_ids": ["e1"], "answer_spans": [span]},
            {"id": "q2", "text": "Who sings?", "answerable": False, "evidence_ids": [], "answer_spans": []},
        ],
    }


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode() if isinstance(content, str) else json.dumps(content).encode())
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_annotations(spark, tmp_path, annotation):
    put(tmp_path, "deed.json", annotation)
    parts = gold.annotations(spark, str(tmp_path))
    assert [tuple(r)[2:] for r in parts["clauses"].orderBy("g_start").collect()] == [("1", 1, None, 0, 9, True, "Fees"), ("1.1", 2, "1", 9, len(TEXT), False, None)]
    assert rows(parts["terms"]) == [("deed", len(TEXT), "ten", 9, 30)]
    assert [(r.raw_text, r.target, TEXT[r.ref_start : r.ref_end]) for r in parts["references"].collect()] == [("1", "1", "1")]
    docs = spark.createDataFrame([("deed", TEXT)], "document_id string, text string")
    assert gold.checked(parts, docs) is parts
    with pytest.raises(GoldError, match="another text"):
        gold.checked(parts, spark.createDataFrame([("deed", TEXT + " ")], "document_id string, text string"))
    # The committed clauses are what extraction finds.
    found = extract.clause_table(extract.extracted(docs.selectExpr("*", "'uk_decimal' AS numbering_style"))).select("identifier", "level", "parent", "g_start", "g_end")
    assert found.exceptAll(parts["clauses"].select("identifier", "level", "parent", "g_start", "g_end")).isEmpty()


@pytest.mark.parametrize(
    ("change", "told"),
    [
        (lambda a: a.pop("n_chars"), "deed.json: n_chars must be a whole number"),
        (lambda a: a.update(clauses=3), "deed.json: clauses must be a list"),
        (lambda a: a["clauses"][1].update(is_top_level="no"), "is_top_level must be true or false"),
        (lambda a: a["defined_terms"][0].update(definition_span=[1]), "two whole numbers"),
        (lambda a: a["cross_references"].append(7), "must be an object"),
        (lambda a: a.update(text_sha256="x"), "a SHA-256"),
    ],
)
def test_broken_annotations(spark, tmp_path, annotation, change, told):
    change(annotation)
    put(tmp_path, "deed.json", annotation)
    with pytest.raises(GoldError, match=told):
        gold.annotations(spark, str(tmp_path))


def test_files_that_are_not_json_or_text(spark, tmp_path, annotation):
    put(tmp_path, "a.json", b'{"document_id": "\xff"}')
    put(tmp_path, "b.json", "{")
    put(tmp_path, "c.json", annotation)
    with pytest.raises(GoldError, match="a.json must be UTF-8; b.json isn't JSON"):
        gold.annotations(spark, str(tmp_path))


YAML = """
document_id: deed
queries:
  - id: deed_q1
    text: Who pays?
    category: clause_lookup
    notes: n
    relevant_clauses:
      - {identifier: "1.1", relevance: 3, description: exact}
      - {identifier: "1", relevance: 1}
  - id: deed_q2
    text: How much?
    failure_mode: old
    relevant_sections: [{section_id: "1.1", relevance: 2}]
"""


def test_queries_of_both_forms(spark, tmp_path):
    put(tmp_path, "deed.yaml", YAML)
    put(tmp_path, "bare.yaml", "queries: [{id: b_q1, text: x, relevant_clauses: [{identifier: '7', relevance: 1}]}]")
    put(tmp_path, "empty.yaml", "")
    want = [
        ("b_q1", "bare", "x", "", "", "7", 1, ""), ("deed_q1", "deed", "Who pays?", "clause_lookup", "n", "1", 1, ""),
        ("deed_q1", "deed", "Who pays?", "clause_lookup", "n", "1.1", 3, "exact"), ("deed_q2", "deed", "How much?", "old", "", "1.1", 2, ""),
    ]
    asked = gold.queries(spark, str(tmp_path))
    assert rows(asked) == want
    formats.register(spark)
    by_format = spark.read.format("spanlab_queries").load(str(tmp_path))
    assert rows(by_format) == want and by_format.rdd.getNumPartitions() == 3
    clauses = spark.createDataFrame([("deed", "1", None, 0, 9), ("deed", "1.1", "1", 9, 40), ("bare", "7", None, 0, 5)], "document_id string, identifier string, parent string, g_start int, g_end int")
    found = gold.resolved_queries(asked, spans.subtree_ends(clauses))
    assert {(r.query_id, r.section_id, r.g_end) for r in found.collect()} == {("b_q1", "7", 5), ("deed_q1", "1", 40), ("deed_q1", "1.1", 40), ("deed_q2", "1.1", 40)}
    with pytest.raises(GoldError, match="unknown clauses"):
        gold.resolved_queries(asked, spans.subtree_ends(clauses.where("identifier <> '7'")))


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("queries: [{text: x}]", "query 0 has no id"),
        ("queries: [{id: q}]", "query q has no text"),
        ("queries: [{id: q, text: x}]", "query q has no relevant clauses"),
        ("queries: [{id: q, text: x, relevant_clauses: [{relevance: 1}]}]", "section 0 has no identifier"),
        ("queries: [{id: q, text: x, relevant_clauses: [{identifier: a, relevance: 0}]}]", "relevance must be one of"),
        ("queries: [{id: q, text: x, relevant_clauses: [{identifier: a}]}]", "relevance must be one of"),
        ("queries: [3]", "query 0 must be an object"),
        ("a: [", "isn't YAML"),
        (b"a: \xff", "must be UTF-8"),
    ],
)
def test_broken_queries(spark, tmp_path, text, told):
    put(tmp_path, "q.yaml", text)
    with pytest.raises(GoldError, match=told):
        gold.queries(spark, str(tmp_path))
    formats.register(spark)
    with pytest.raises(PythonException, match=told):
        spark.read.format("spanlab_queries").load(str(tmp_path)).collect()


def test_evidence_set(spark, tmp_path, evidence):
    put(tmp_path, "texts/deed.txt", DEED)
    path = put(tmp_path, "set.json", evidence)
    parts = gold.evidence_dataset(spark, path)
    assert [(r.document_id, r.text, r.jurisdiction, r.provenance_kind) for r in parts["documents"].collect()] == [("deed", TEXT, "uk", "synthetic")]
    corpus = parts["corpus"].first()
    assert (corpus.id, corpus.held_out, corpus.customer_proof) == ("c", True, False)
    with open(path, "rb") as file:
        assert corpus.manifest_sha256 == hashlib.sha256(file.read()).hexdigest()
    assert [(r.query_id, r.answerable, r.evidence_ids) for r in parts["queries"].orderBy("query_id").collect()] == [("q1", True, ["e1"]), ("q2", False, [])]
    formats.register(spark)
    for part, schema in records.EVIDENCE.items():
        read = spark.read.format("spanlab_evidence").option("part", part).load(path)
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema) == schema
        assert rows(read) == rows(parts[part].select(read.columns))


@pytest.mark.parametrize(
    ("change", "told"),
    [
        (lambda e: e.update(schema_version="v0"), "schema_version must be"),
        (lambda e: e.pop("corpus"), "corpus must be an object"),
        (lambda e: e["corpus"].update(authorship="me"), "authorship must be one of"),
        (lambda e: e["corpus"].update(legal_validation="human_reviewed"), "all documents of a human_reviewed corpus"),
        (lambda e: e["documents"][0].update(path="../deed.txt"), "within the folder"),
        (lambda e: e["documents"][0].update(path="texts/none.txt"), "deed: file is missing"),
        (lambda e: e["documents"][0].update(sha256="0" * 64), "another SHA-256"),
        (lambda e: e["documents"][0]["provenance"].update(kind="public_source"), "a public one has"),
        (lambda e: e["documents"].append(e["documents"][0]), "is there twice"),
        (lambda e: e["documents"].clear(), "documents must not be empty"),
        (lambda e: e["evidence"][0].update(grade=True), "grade must be one of"),
        (lambda e: e["evidence"][0].update(start="3"), "start must be a whole number"),
        (lambda e: e["evidence"][0].update(text="something else"), "slice of e1"),
        (lambda e: e["queries"][0].update(evidence_ids=["e1", "e1"]), "different strings"),
        (lambda e: e["queries"][0].update(evidence_ids=["e9"]), "unknown evidence e9"),
        (lambda e: e["queries"][1].update(answerable=True), "answerable queries have"),
        (lambda e: e["queries"][0].pop("text"), "text must be a string"),
    ],
)
def test_broken_evidence_sets(spark, tmp_path, evidence, change, told):
    put(tmp_path, "texts/deed.txt", DEED)
    change(evidence)
    with pytest.raises(GoldError, match=told):
        gold.evidence_dataset(spark, put(tmp_path, "set.json", evidence))


def test_texts_that_are_not_utf8(spark, tmp_path, evidence):
    put(tmp_path, "texts/deed.txt", b"\xff\xfe")
    evidence["documents"][0]["sha256"] = hashlib.sha256(b"\xff\xfe").hexdigest()
    with pytest.raises(GoldError, match="deed: must be UTF-8"):
        gold.evidence_dataset(spark, put(tmp_path, "set.json", evidence))


def test_formats_name_their_faults(spark, tmp_path):
    formats.register(spark)
    with pytest.raises(Exception, match="part is one of"):
        spark.read.format("spanlab_annotations").option("part", "nothing").load(str(tmp_path))
    with pytest.raises(Exception, match="no files at"):
        spark.read.format("spanlab_annotations").load(str(tmp_path / "none")).collect()
