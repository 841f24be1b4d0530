"""Queries over identifiers far above the smallest ones: no row may be left out by its identifier."""

import duckdb
import pytest

from spanlab.plans import catalog
from tests.test_oracles import SF, rows


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables, every document's identifier moved up."""
    out = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT * REPLACE (doc_id + 1000 AS doc_id) FROM '{SF}/documents.parquet') TO '{out}/documents.parquet'")
    for t in ("benchmark", "embeddings"):
        duckdb.sql(f"COPY (FROM '{SF}/{t}.parquet') TO '{out}/{t}.parquet'")
    return out



def agree(spark, name, tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, str(tables)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


NAMES = """gld2_uk_decimal gld8_defined_terms gld9_references sm4_headings sm6_cross_references rm9_text_relevance em1_hashed_embedder src13_cache_split
 win1_lexical_top_k rm2_rm8_metrics jn9_paired_differences st1_paired_bootstrap st3_t_statistic st8_leave_one_document_out""".split()


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, far, name):
    agree(spark, name, far)


@pytest.mark.parametrize("name, of_each", [("sm5_definition_attachment", 1), ("lg_legacy_row", 2)])
def test_structure_without_oracle(spark, far, name, of_each):
    assert catalog.queries()[name](spark, str(far)).count() == 200 * of_each


def test_comparison_matrix_has_all_pairs(spark, far):
    assert {r.n for r in catalog.queries()["st9_comparison_matrix"](spark, str(far)).collect()} == {200}
