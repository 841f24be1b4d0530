"""Ranks, corrections and resampling over groups of any size, against plain versions; tiny ranges and slices give the same."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.operators import classification as C, ranges, stats as ST


@pytest.fixture(autouse=True, params=[None, 2], ids=["one range", "many ranges"])
def small_ranges(request, monkeypatch):
    """Once more with ranges for groups of three rows, and slices of two cells."""
    if request.param:
        dealt = ranges.dealt
        monkeypatch.setattr(ranges, "dealt", lambda rows, by, order, **sums: dealt(rows, by, order, 7, request.param, **sums))
        monkeypatch.setattr(ST, "CELLS", 2)


def table(spark, seed=1, n=300):
    draw = random.Random(seed)
    values = [None, math.nan, *(x / 4 for x in range(-9, 10))]
    return spark.createDataFrame([(draw.choice(["a", "b", None]), i, draw.choice(values)) for i in range(n)] + [("one", n, 1.5)], "g string, i int, x double")


def key(x):
    return (x is not None, math.isnan(x) if x is not None else False, 0.0 if x is None or math.isnan(x) else x)


def test_average_ranks(spark):
    rows = table(spark).collect()
    got = {r.i: r.rank for r in ST.average_ranks(table(spark), ["g"], "x", "rank").collect()}
    for r in rows:
        own = [key(s.x) for s in rows if s.g == r.g]
        assert got[r.i] == sum(k < key(r.x) for k in own) + (sum(k == key(r.x) for k in own) + 1) / 2


def test_before_of_sums_and_maxima(spark):
    rows = spark.createDataFrame([(g, k, (k * 37) % 23) for g in ("a", "b") for k in range(40)], "g string, k int, v int")
    got = ranges.before(ranges.dealt(rows, ["g"], "k"), ["g"], "k", total=("sum", "v"), top=("max", "v")).collect()
    for r in got:
        own = [(k * 37) % 23 for k in range(r.k)]
        assert (r.total, r.top) == (sum(own), max(own, default=None))
    whole = ranges.before(ranges.dealt(rows.where("g = 'a'"), [], "k"), [], "k", total=("sum", F.lit(1)))
    assert {(r.k, r.total) for r in whole.collect()} == {(k, k) for k in range(40)}


def plain_holm(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, top = [0.0] * len(p), 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, p[i] * (len(p) - rank)))
        out[i] = top
    return out


def test_holm_of_a_family_and_of_groups(spark):
    draw = random.Random(2)
    p = [draw.choice([0.001, 0.01, draw.random() / 50]) for _ in range(120)]
    rows = spark.createDataFrame([(i, "ab"[i % 2], x) for i, x in enumerate(p)] + [(999, "a", None)], "i int, g string, p double")
    got = {r.i: r.p_holm for r in ST.holm(rows, "p").collect()}
    assert got.pop(999) is None and np.allclose([got[i] for i in range(120)], plain_holm(p))
    got = {r.i: r.p_holm for r in ST.holm(rows, "p", ["g"]).collect()}
    assert np.allclose([got[i] for i in range(0, 120, 2)], plain_holm(p[::2]))


def test_signed_ranks_and_wilcoxon(spark):
    draw = random.Random(3)
    groups = {"ties": [draw.randrange(-5, 6) / 2 for _ in range(70)], "exact": [1.0, -2.0, 3.0, 4.0, -5.5], "zeros": [0.0, 0.0], "up": [1.0, 1.0, 1.0]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, diff double")
    got = {r.g: r for r in ST.signed_ranks(rows, ["g"]).collect()}
    for g, xs in groups.items():
        some = [x for x in xs if x]
        rank = [sum(abs(y) < abs(x) for y in some) + (sum(abs(y) == abs(x) for y in some) + 1) / 2 for x in some]
        plus, minus = (sum(r for r, x in zip(rank, some) if x * sign > 0) for sign in (1, -1))
        tied = sum(t**3 - t for t in Counter(map(abs, some)).values())
        assert (got[g].w_plus, got[g].w_minus, got[g].n_nonzero) == (plus, minus, len(some))
        assert math.isclose(got[g].p_wilcoxon, ST.wilcoxon_p_value(len(some), plus, tied))
    # By counting all signs: rank sums of 5 differences at most as far out as 7.
    ways = [sum(r for k, r in enumerate(range(1, 6)) if mask >> k & 1) for mask in range(32)]
    assert math.isclose(got["exact"].p_wilcoxon, min(1, 2 * sum(w <= 7 for w in ways) / 32)) and got["zeros"].p_wilcoxon == 1.0


def test_spearman(spark):
    draw = random.Random(4)
    data = [(g, draw.randrange(20), draw.randrange(9)) for g in ("a", "b") for _ in range(90)] + [("flat", 1, k) for k in range(5)] + [("one", 1, 1)]
    got = {r.g: r.spearman for r in ST.spearman(spark.createDataFrame(data, "g string, x int, y int"), ["g"], "x", "y").collect()}
    for g in ("a", "b"):
        ranks = [[sum(w < v for w in s) + (sum(w == v for w in s) + 1) / 2 for v in s] for s in zip(*[(x, y) for k, x, y in data if k == g])]
        assert math.isclose(got[g], np.corrcoef(*ranks)[0, 1], rel_tol=1e-9)
    assert got["flat"] == got["one"] == 0.0


def scrambled(x):
    for _ in range(2):
        x = (x ^ (x >> 16)) * 73244475 % (1 << 32)
    return x ^ (x >> 16)


def plain_draws(n, r, seed=42):
    base = scrambled((r + seed * 1_000_003) % (1 << 32))
    return [scrambled(base ^ scrambled(i + 1)) % n for i in range(n)]


def test_resampled_means(spark):
    groups = {"a": [float(i % 5) for i in range(41)], None: [0.5, 0.25], "one": [7.0]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in reversed(xs)], "g string, x double")
    got = {(r.g, r.r): r.m for r in ST.resampled_means(rows, ["g"], "x", 30, 42).collect()}
    assert len(got) == 60
    for (g, r), m in got.items():
        values = sorted(groups[g])
        assert math.isclose(m, sum(values[k] for k in plain_draws(len(values), r)) / len(values))
    ends = {r.g: (r.low, r.high) for r in ST.bootstrap_means(rows, ["g"], "x", 30).collect()}
    assert ends["one"] == (None, None) and math.isclose(ends["a"][0], np.percentile([got["a", r] for r in range(30)], 2.5))
    points = {r.g: (r.point, r.low) for r in ST.order_statistic_interval(rows, ["g"], "x", 30).collect()}
    assert points["one"] == (7.0, 7.0) and math.isclose(points["a"][1], sorted(got["a", r] for r in range(30))[0])


def test_resampled_counts_and_scores(spark):
    draw = random.Random(5)
    data = [("s", i, draw.choice("xyz"), draw.choice("xy"), 0.5) for i in range(50)]
    items = spark.createDataFrame(data, "system string, item_id int, gold string, pred string, confidence double")
    got = Counter()
    for r in ST.resampled_counts(items, ["system"], ["gold", "pred"], 20, 42).collect():
        got[r.r, r.gold, r.pred] += r.n
    order = sorted((g, p) for _, _, g, p, _ in data)
    want = Counter((r, *order[k]) for r in range(20) for k in plain_draws(50, r))
    assert got == want
    accuracy = sorted(sum(order[k][0] == order[k][1] for k in plain_draws(50, r)) / 50 for r in range(20))
    row = C.score_system(items, ["system"], 20).first()
    assert math.isclose(row.accuracy_low, accuracy[0]) and math.isclose(row.accuracy_high, accuracy[19])


def test_many_places_by_binary_search(monkeypatch):
    """Without the table of places the same cells are drawn."""
    ends, rounds = np.cumsum([5, 1, 90, 4]), np.arange(6)
    plain = [(k, cells.tolist()) for k, cells in ST._drawn(ends, 0, 100, rounds, 1)]
    monkeypatch.setattr(ST, "_PLACES", 0)
    assert [(k, cells.tolist()) for k, cells in ST._drawn(ends, 0, 100, rounds, 1)] == plain


def test_no_window_over_a_whole_group(spark):
    """Windows are by range; those by group alone go over ranges, not rows. No values come to the driver for a plan."""
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") % 77).cast("double").alias("diff"), (F.col("id") % 5).alias("y"))
    for built in (ST.average_ranks(rows, ["g"], "diff", "rank"), ST.holm(rows, "diff"), ST.spearman(rows, ["g"], "diff", "y")):
        plan = built._jdf.queryExecution().analyzed().toString()
        keys = [line.split("], [")[1] for line in plan.splitlines() if "Window [" in line and line.count("], [") >= 2]
        assert keys and all("_range" in line for line in plan.splitlines() if "Window [" in line)
