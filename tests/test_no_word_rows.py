"""Queries that rank, score or seek items make no rows of words: what is joined on words has rows of queries times windows, or items times documents."""

import re

import pytest

from spanlab.plans import catalog
from tests.test_oracles import SF

NAMES = """rm1_relevance rm2_rm8_metrics jn4_selected_evidence agg4_evidence_means agg3_evidence_score rm5_assignment_ndcg
 val6_candidate_ids val7_selected_spans agg24_budget_totals win3_budget_clip flt6_valid_ranks win1_lexical_top_k
 win4_rank_normalisation flt9_positive_overlap jn6_token_dot rm9_text_metrics""".split()


@pytest.mark.parametrize("name", NAMES)
def test_words_stay_in_their_rows(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan
    assert not re.search(r"explode\([^\n]*regexp_extract_all", plan)
