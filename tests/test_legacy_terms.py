"""Superseded definition metric: terms sought together give what a pattern for each gives."""

import random
import re

from spanlab.operators import legacy
from spanlab.operators.terms import Phrases


def test_defined_terms_against_a_pattern_each():
    draw = random.Random(2)
    pieces = ["fee", "the fee", "goods", '"', "'", " ", "\n", "means", "shall  mean", "refers to", "defined\nas", "x" * 79, "filler words "]
    for _ in range(500):
        text = "".join(draw.choices(pieces, k=12)).title()
        terms = ["fee", "the fee", "goods", "nowhere"]
        want = {t for t in terms if re.search(rf"(?s){re.escape(t)}[\"']?\s*.{{0,80}}?{legacy.DEFINING}", text.lower())}
        assert legacy.defined_in(text, Phrases(terms)) == want
