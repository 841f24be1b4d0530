"""Files of ground truth to typed records: annotations, query files and anchored evidence, with errors that name the fault.

Plain functions from a file's bytes to rows; `gold` runs them over what Spark reads from any store, `formats` puts them behind
`spark.read.format`.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any


class GoldError(ValueError):
    """Ground truth breaks a rule."""


# The version of evidence sets, and what their fields may say.
SCHEMA_VERSION = "anchored_evidence_v1"
GRADES = (1, 2, 3)
ALLOWED = {
    "authorship": ("ai_authored", "human_authored", "mixed", "unknown"),
    "legal_validation": ("not_human_reviewed", "human_reviewed", "unknown"),
    "jurisdiction": ("uk", "us", "eu"),
    "kind": ("synthetic", "public_source", "customer_supplied"),
    "license_status": ("project_license", "declared_by_source", "unknown"),
    "review_status": ("not_human_reviewed", "human_reviewed", "unknown"),
}
#: The columns of each kind of record.
QUERY = "query_id string, document_id string, text string, category string, notes string, identifier string, grade int, description string"
EVIDENCE = {
    "corpus": "id string, title string, description string, authorship string, legal_validation string, held_out boolean, customer_proof boolean, manifest_sha256 string",
    "documents": "document_id string, path string, sha256 string, jurisdiction string, provenance_kind string, source_url string, license_status string, license_identifier string, review_status string",
    "evidence": "evidence_id string, document_id string, g_start int, g_end int, text string, grade int",
    "queries": "query_id string, text string, answerable boolean, evidence_ids array<string>",
    "answer_spans": "query_id string, document_id string, char_start int, char_end int, text string",
}
ANNOTATION = {
    "documents": "document_id string, source_file string, text_sha256 string, n_chars int, numbering_style string",
    "clauses": "document_id string, n_chars int, identifier string, level int, parent string, g_start int, g_end int, is_top_level boolean, heading string",
    "terms": "document_id string, n_chars int, term string, definition_start int, definition_end int",
    "references": "document_id string, n_chars int, raw_text string, ref_start int, ref_end int, target string, kind string",
}


class Fields:
    """A mapping whose values are asked for by kind."""

    def __init__(self, value: Any, label: str):
        if not isinstance(value, dict):
            raise GoldError(f"{label} must be an object")
        self.value, self.label = value, label

    def _is(self, key: str, found: bool, what: str) -> Any:
        if not found:
            raise GoldError(f"{self.label}: {key} must be {what}")
        return self.value.get(key)

    def text(self, key: str) -> str:
        x = self.value.get(key)
        return self._is(key, isinstance(x, str) and bool(x.strip()), "a string that isn't empty")

    def one_of(self, key: str, allowed: tuple) -> Any:
        x = self.value.get(key)
        return self._is(key, x in allowed and not isinstance(x, bool), f"one of {list(allowed)}")

    def boolean(self, key: str) -> bool:
        return self._is(key, isinstance(self.value.get(key), bool), "true or false")

    def integer(self, key: str) -> int:
        x = self.value.get(key)
        return self._is(key, isinstance(x, int) and not isinstance(x, bool), "a whole number")

    def optional(self, key: str) -> str | None:
        x = self.value.get(key)
        return self._is(key, x is None or isinstance(x, str), "a string or null")

    def digest(self, key: str) -> str:
        x = self.value.get(key)
        return self._is(key, isinstance(x, str) and len(x) == 64 and set(x) <= set("0123456789abcdef"), "a SHA-256 in lower case")

    def mapping(self, key: str) -> Fields:
        return Fields(self.value.get(key), f"{self.label}: {key}")

    def items(self, key: str) -> list:
        return self._is(key, isinstance(self.value.get(key), list), "a list")

    def each(self, key: str, label: str) -> Iterator[Fields]:
        for k, item in enumerate(self.items(key)):
            yield Fields(item, f"{self.label}: {label} {item['id'] if isinstance(item, dict) and isinstance(item.get('id'), str) else k}")


def decoded(content: bytes, label: str) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as problem:
        raise GoldError(f"{label} must be UTF-8") from problem


def loaded(content: bytes, label: str) -> Fields:
    text = decoded(content, label)
    try:
        return Fields(json.loads(text), label)
    except json.JSONDecodeError as problem:
        raise GoldError(f"{label} isn't JSON: {problem.msg}") from problem


def query_rows(path: str, content: bytes) -> Iterator[tuple]:
    """QUERY rows of a YAML file, one for each section that a query points to. Names of the older form are read where the
    present ones are missing; a file without document_id is of the document of its name."""
    import yaml

    name = PurePosixPath(path)
    try:
        file = yaml.safe_load(decoded(content, name.name)) or {}
    except yaml.YAMLError as problem:
        raise GoldError(f"{name.name} isn't YAML: {problem}") from problem
    file = Fields(file, name.name)
    document = file.value.get("document_id", name.stem)
    for k, item in enumerate(file.value.get("queries") or []):
        query = Fields(item, f"{name.name}: query {item.get('id', k) if isinstance(item, dict) else k}")
        for key in ("id", "text"):
            if key not in query.value:
                raise GoldError(f"{query.label} has no {key}")
        category = query.value.get("category")
        category = query.value.get("failure_mode", "") if category is None else category
        key, called = ("relevant_sections", "section_id") if query.value.get("relevant_clauses") is None else ("relevant_clauses", "identifier")
        if not query.value.get(key):
            raise GoldError(f"{query.label} has no relevant clauses")
        for section in query.each(key, "section"):
            if called not in section.value:
                raise GoldError(f"{section.label} has no {called}")
            grade = section.one_of("relevance", GRADES)
            told = (query.value["id"], document, query.value["text"], category, query.value.get("notes", ""))
            yield (*told, section.value[called], grade, section.value.get("description", ""))


def _once(seen: set[str], name: str, label: str) -> str:
    if name in seen:
        raise GoldError(f"{label} is there twice")
    seen.add(name)
    return name


def evidence_rows(path: str, content: bytes) -> Iterator[tuple[str, tuple]]:
    """(part, row) of an anchored-evidence file. What needs the texts, or other records, is checked relationally later."""
    name = PurePosixPath(path).name
    root = loaded(content, name)
    if root.value.get("schema_version") != SCHEMA_VERSION:
        raise GoldError(f"{name}: schema_version must be {SCHEMA_VERSION}")
    corpus = root.mapping("corpus")
    reviewed = corpus.one_of("legal_validation", ALLOWED["legal_validation"]) == "human_reviewed"
    told = (*(corpus.text(k) for k in ("id", "title", "description")), corpus.one_of("authorship", ALLOWED["authorship"]))
    yield "corpus", (*told, corpus.text("legal_validation"), corpus.boolean("held_out"), corpus.boolean("customer_proof"), hashlib.sha256(content).hexdigest())
    seen: dict[str, set[str]] = {"documents": set(), "evidence": set(), "queries": set()}
    for d in root.each("documents", "document"):
        key = _once(seen["documents"], d.text("id"), d.label)
        place = posixpath.normpath(d.text("path"))
        if place.startswith(("/", "..")):
            raise GoldError(f"{d.label}: path must stay within the folder of the set")
        source = d.mapping("provenance")
        kind, url = source.one_of("kind", ALLOWED["kind"]), source.optional("source_url")
        if (kind == "synthetic" and url is not None) or (kind == "public_source" and url is None):
            raise GoldError(f"{d.label}: a synthetic text has no source_url, a public one has")
        review = d.one_of("review_status", ALLOWED["review_status"])
        if reviewed and review != "human_reviewed":
            raise GoldError(f"{d.label}: all documents of a human_reviewed corpus are reviewed")
        rights = d.one_of("license_status", ALLOWED["license_status"]), d.text("license_identifier")
        yield "documents", (key, place, d.digest("sha256"), d.one_of("jurisdiction", ALLOWED["jurisdiction"]), kind, url, *rights, review)
    for e in root.each("evidence", "evidence"):
        key = _once(seen["evidence"], e.text("id"), e.label)
        yield "evidence", (key, e.text("document_id"), e.integer("start"), e.integer("end"), e.text("text"), e.one_of("grade", GRADES))
    for q in root.each("queries", "query"):
        key, answerable = _once(seen["queries"], q.text("id"), q.label), q.boolean("answerable")
        ids, spans = q.items("evidence_ids"), list(q.each("answer_spans", "answer span"))
        if any(not isinstance(i, str) or not i.strip() for i in ids) or len(set(ids)) < len(ids):
            raise GoldError(f"{q.label}: evidence_ids must be different strings")
        if answerable != bool(spans) or answerable != bool(ids):
            raise GoldError(f"{q.label}: answerable queries have answer spans and evidence, others neither")
        yield "queries", (key, q.text("text"), answerable, ids)
        for s in spans:
            yield "answer_spans", (key, s.text("document_id"), s.integer("start"), s.integer("end"), s.text("text"))
    for part in ("documents", "queries"):
        if not seen[part]:
            raise GoldError(f"{name}: {part} must not be empty")


def annotation_rows(path: str, content: bytes) -> Iterator[tuple[str, tuple]]:
    """(part, row) of an annotation file."""
    root = loaded(content, PurePosixPath(path).name)
    head = root.text("document_id"), root.integer("n_chars")
    yield "documents", (head[0], root.text("source_file"), root.digest("text_sha256"), head[1], root.text("numbering_style"))
    for c in root.each("clauses", "clause"):
        span = c.integer("char_start"), c.integer("char_end")
        yield "clauses", (*head, c.text("identifier"), c.integer("level"), c.optional("parent"), *span, c.boolean("is_top_level"), c.optional("heading"))
    for t in root.each("defined_terms", "term"):
        span = t.items("definition_span")
        if len(span) != 2 or any(not isinstance(x, int) or isinstance(x, bool) for x in span):
            raise GoldError(f"{t.label}: definition_span must be two whole numbers")
        yield "terms", (*head, t.text("term"), *span)
    for r in root.each("cross_references", "reference"):
        start, raw = r.integer("char_start"), r.text("raw_text")
        yield "references", (*head, raw, start, start + len(raw), r.optional("target_identifier"), r.text("kind"))
