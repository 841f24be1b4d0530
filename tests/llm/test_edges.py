"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlab.llm import exact_dedup, language, line_dedup, mixing, neighbours, packing, sharding, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp string, rank int, id string, row string, _bucket int, norm string"
LONG = "wörd " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with clashing names; doc 7 stands twice."""
    texts = [(1, "same text here, quite"), (2, "same text here, quite"), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, "Again and again"), (7, "Again and again"), (None, "without a number"), (8, "12 34 !!"), (9, None), (10, "ﬁn, Σ <|endoftext|> 'tis it's")]
    return spark.createDataFrame([(d, t, None if d in (3, 8) else "en", None if d == 4 else "s1", None, 1, "x", 2, "i", "r", 3, "n") for d, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_exact_dedup(odd, none):
    got = {(r.doc_id, r.kept): r for r in exact_dedup.exact_dedup(odd).collect()}
    assert got[2, True].keep_id == 2 and got[1, False].keep_id == 2 and got[1, False].group_size == 2
    assert got[9, True].group_size == 3 and got[3, False].keep_id == 9 and got[4, False].keep_id == 9  # null and empty
    assert got[7, True].group_size == 2 and (7, False) in got and got[None, True].keep_id is None
    kept = exact_dedup.exact_deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.exact_dedup(none).count() == 0
    smallest = exact_dedup.exact_dedup(odd, keep="smallest").where("doc_id = 2").first()
    assert smallest.keep_id == 1 and not smallest.kept
    folded = exact_dedup.exact_dedup(odd, normalize=lambda t: F.lower(F.trim(t))).where("doc_id in (4, 5)")
    assert folded.count() == 2


def test_exact_dedup_group_over_many_ranges(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 300).cast("string"))).alias("text"))
    got = exact_dedup.exact_dedup(docs).toPandas()
    want = docs.toPandas().groupby("text").doc_id.agg(["max", "size"])
    both = got.merge(docs.toPandas(), on="doc_id")
    assert (both.keep_id == want["max"][both.text].values).all() and (both.group_size == want["size"][both.text].values).all()
    assert got.kept.sum() == len(want) and (got.kept == (got.doc_id == got.keep_id)).all()


def test_sharding(spark, odd, none):
    store = sharding.sharded(odd, target_bytes=1 << 30, fanout=2)
    assert store.read(odd.columns).select(*odd.columns).exceptAll(odd).count() == 0 and store.read(["doc_id"]).count() == odd.count()
    before = store.version()
    store.append(odd)
    assert store.version() == before + 1 and store.read(["doc_id"]).count() == 2 * odd.count()
    assert store.manifest(before).agg(F.sum("rows")).first()[0] == odd.count()  # older versions stay readable until vacuum
    while (v := store.version()) != store.compact():
        assert store.version() == v + 1
    store.vacuum()
    assert store.read(["doc_id"]).count() == 2 * odd.count()
    with pytest.raises(sharding.ConflictError):
        store._commit(store.manifest(), store.version() - 1)
    empty = sharding.sharded(none).read(["doc_id"])
    assert empty.columns[0] == "doc_id" and empty.count() == 0
    with pytest.raises(FileNotFoundError):
        sharding.ShardStore(spark, f"{store.root}/nothing").read(["doc_id"])


def test_sharding_clashing_names(spark, odd):
    names = ["merge_group", "shard", "arrival", "file", "_arrival", "_from", "tier", "dealt"]
    docs = odd.select("doc_id", "text", *[F.concat(F.lit(n), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    store = sharding.sharded(docs, target_bytes=1 << 30, fanout=2)
    rows = store.read(docs.columns)
    assert store.version() > 1 and rows.columns == [*docs.columns, "_shard", "shard_bytes", "shard_rows", "_tier", "version"]
    assert rows.select(*docs.columns).exceptAll(docs).isEmpty() and rows.count() == docs.count()


def test_sharding_versions_and_plan(spark):
    """Each version stays as it was; groups follow a plain version of the plan; files hold what the manifest says."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    store = sharding.sharded(docs, target_bytes=60_000, fanout=3, shard_rows=50, round_files=40)
    assert store.version() > 3
    for v in range(1, store.version() + 1):
        assert sorted(r.doc_id for r in store.read(["doc_id"], v).select("doc_id").collect()) == list(range(4000))
    for r in store.manifest().collect():
        held = spark.read.parquet(r.path)
        assert held.count() == r.rows and [x.shard for x in store.read(["doc_id"]).where(F.col("shard") == r.shard).select("shard").distinct().collect()] == [r.shard]
    groups = {}
    for r in store.planned(1).collect():
        groups.setdefault(r.merge_group, set()).add(r.path)
    small, want = {}, []
    for r in store.manifest(1).collect():
        small.setdefault(r.tier, []).append((r.bytes, r.shard, r.path))
    for tier in sorted(small):
        total, n, at, own = sum(b for b, *_ in small[tier]), max(1, round(sum(b for b, *_ in small[tier]) / 60_000)), 0, {}
        for size, _, path in sorted(small[tier]):
            own.setdefault(min(n - 1, int((at + size / 2) * n / total)), []).append((size, path))
            at += size
        want += [{p for _, p in x} for _, x in sorted(own.items()) if len(x) > 1 and (len(x) >= 3 or sum(b for b, _ in x) >= 30_000)]
    taken = []
    for w in want:
        if taken and sum(map(len, taken)) + len(w) > 40:
            break
        taken.append(w)
    assert [groups[g] for g in sorted(groups)] == taken
    store.vacuum()
    assert store.read(["doc_id"]).count() == 4000
    with pytest.raises(Exception, match="v00000001"):
        store.read(["doc_id"], 1)
    store.fs.create(store._version_file(store.version() + 1), False).close()  # as a writer that died leaves it
    with pytest.raises(sharding.ConflictError):
        store.append(docs)
    store.recover()
    store.append(docs)
    assert store.read(["doc_id"]).count() == 8000


def plain_components(prints):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_simhash(odd, none):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert got[1].component_id == got[2].component_id == 1
    assert {got[d].fingerprint for d in (3, 4, 5, 9)} == {"0" * 16} and got[9].component_id == 3
    assert got[None].component_id is None
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns and {2, 4, 5, 9}.isdisjoint({r.doc_id for r in kept.collect()})


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_simhash_links_in_dense_groups(spark, block_rows):
    """Small blocks make the finer bands and the tiles do the work."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres[:3]:
        for _ in range(120):
            values.add(int(c) ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)))
    prints = dict(enumerate(sorted(values)))
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in prints.items()}
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), 3, block_rows)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    groups = {}
    for k, v in signed.items():
        groups.setdefault(roots.get(v, v), set()).add(k)
    want = {}
    for k, root in plain_components(prints).items():
        want.setdefault(root, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_language(spark, odd, none):
    got = {r.doc_id: r for r in language.identified(odd).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (3, 4, 5, 8, 9))
    assert got[6].lang_pred == "en" and got[6].score == 1.0
    assert language.identified(none).count() == 0
    untaught = language.identified(odd.withColumn("lang", F.lit(None).cast("string")))
    assert untaught.where("lang_pred <> 'und'").count() == 0
    kept = language.in_known_language(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, None, 10}


def test_neighbours(spark):
    vectors = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (200, [0.0, 2.0]), (7, [None, 1.0]), (0, [3.0, 0.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, part int")
    got = neighbours.nearest(rows).toPandas()
    assert set(got.query_id) == {0, 200}
    of = lambda rows: [None if np.isnan(v) else int(v) for v in rows.sort_values("rank").vec_id]
    assert of(got[got.query_id == 200]) == [None, 0, 1, 2, 0]  # a row without identifier is a row of the table
    twice = [of(own) for _, own in got[got.query_id == 0].groupby("query_row")]
    assert sorted(twice, key=str) == [[0, 1, 2, None, 200], [1, 2, None, 0, 200]]  # each row that repeats an identifier asks for itself
    other = spark.createDataFrame([(100, [1.0]), (1, [3.0]), (2, [2.0]), (200, [1.0, 0.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(other).collect()) == [(100, 1, 2), (100, 2, 1), (200, 1, 3)]  # by dimension
    assert neighbours.nearest(rows.where("false")).count() == 0
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16)).astype("float32")
    many = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(many, sample_rows=3000, block_rows=300).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hits / 600 >= 0.9 and (got.groupby("query_id").size() == 10).all()


def test_neighbours_tree_grows_with_the_table(spark):
    """Ten times the rows: recall holds, and the vectors that a query is compared with hardly grow."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 16)) * 3
    seen = {}
    for n in (4000, 40_000):
        x = (centres[rng.integers(0, 300, n)] + rng.normal(size=(n, 16))).astype("float32")
        index = spark.createDataFrame([(i, i, v) for i, v in enumerate(x.tolist())], "row long, id long, vec array<float>")
        forest = neighbours.grown(index, 11, 0.97, 2000, 128, 500, 4096, 1 << 28, 1)
        asked = x[::400].astype(float)
        leaves = forest.leaves(x.astype(float))
        probed = forest.probed(asked, 11)
        hits = 0
        for q, own in zip(asked, probed):
            d = ((x.astype(float) - q) ** 2).sum(1)
            hits += np.isin(leaves[np.argsort(d)[1:11]], own).sum()
        assert hits / (10 * len(asked)) >= 0.9
        seen[n] = np.mean([sum(forest.sizes[16, v] for v in own) for own in probed])
    assert seen[40_000] < 4 * seen[4000], seen


def test_neighbours_of_many_equal_vectors(spark):
    """A third of the rows share one vector; answers are those of brute force."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 4)).astype("float32")
    x[::3] = x[0]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(docs, aim=1.0, sample_rows=600, part_rows=64, leaf_rows=100, block_rows=50).toPandas()
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert np.allclose(own.score, d[want]) and (q % 3 or own.vec_id.tolist() == want)


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(odd, path).toPandas()
    assert sorted(got.columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy"])
    assert (got[got.doc_id == 3].length == 1).all() and len(got[got.doc_id == 7]) == 2
    long = got[got.doc_id == 6].sort_values("piece")
    assert long.length.tolist()[:-1] == [4096] * (len(long) - 1) and long.length.sum() == 1 + len(Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 4096
    assert packing.packed(none, path).count() == 0


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps[gaps.index(min(fits))] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_packing_sweep_is_best_fit_decreasing():
    """One sweep over all sizes, with empty gaps enough."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(1, 41, 200).tolist()
        counts = {s: sizes.count(s) for s in set(sizes)}
        segments, left, gaps = packing.swept([(s, 0, n) for s, n in counts.items()], [(40, 0, 200)], 1, 40)
        assert not left and 200 - sum(n for size, _, n in gaps if size == 40) == best_fit_decreasing(sizes, 40)
        assert {s: sum(n for length, _, n, *_ in segments if length == s) for s in counts} == counts


def test_packing_rounds_over_ranges(spark):
    """Ranges swept apart, pieces that cross ranges and further sequences: all pieces placed, hardly more sequences."""
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 41, 400), rng.integers(15, 30, 300), np.array([21] * 40 + [3] * 5)):
        counts = {int(s): int((sizes == s).sum()) for s in set(sizes)}
        lengths = spark.createDataFrame(list(counts.items()), "length long, n long")
        used = {}
        for r in packing.placed(lengths, 40, ranges=3).collect():
            for i in range(r.many):
                used.setdefault(r.sequence + i // r.places, []).append((r["at"] + i % r.places * r.length, r.length, r.first + i))
        ranks = sorted((n, k) for pieces in used.values() for _, n, k in pieces)
        assert ranks == sorted((s, k) for s, n in counts.items() for k in range(n))
        for pieces in used.values():
            ends = np.cumsum([n for _, n, _ in sorted(pieces)])
            assert [at for at, *_ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 40
        assert len(used) <= 1.03 * best_fit_decreasing(sizes.tolist(), 40) + 1


def test_line_dedup(spark, none):
    para = " ".join(["word"] * 50)
    docs = spark.createDataFrame([(1, f"a\nb\n\nc\n{para}"), (2, f"x\na\nb\ny\n{para}\nc"), (3, None), (4, ""), (5, "q\nq\nq\nq"), (6, "a\nb\nc"), (6, "a\nb\nc"), (None, "c\nz")], "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("line", F.lit("l"))
    got = {r.doc_id: r for r in line_dedup.line_deduplicated(docs).collect()}
    assert got[1].text == f"a\nb\n\nc\n{para}" and got[1].n_removed == 0
    assert got[2].text == "x\ny\nc" and [tuple(r) for r in got[2].removed_runs] == [(1, 2), (4, 4)]
    assert got[3].text is None and got[4].text == "" and got[5].text == "q\nq" and got[6].text == "" and got[None].text == "c\nz"
    assert line_dedup.line_deduplicated(docs.where("false")).count() == 0
    assert line_dedup.line_deduplicated(none.select("doc_id", "text")).count() == 0
    deep = {r.doc_id: r.text for r in line_dedup.line_deduplicated(docs, min_lines=3, min_words=1000).collect()}
    assert deep[2] == f"x\na\nb\ny\n{para}\nc" and deep[1] == f"a\nb\n\nc\n{para}" and deep[6] == ""


def test_line_dedup_maximal_runs(spark):
    """Runs of more lines than the least depth, with their originals and lengths, against all pairs of places."""
    rng = np.random.default_rng(6)
    base = [f"l{i}" for i in range(40)]
    texts = ["\n".join(base), "\n".join(["x", *base[5:17], "y", *base[30:33], "z"]), "\n".join([*base[3:9], *base[5:17]]), "\n".join(base[20:22] * 3), "\n".join(base), "\n".join(rng.choice(["a", "b"], 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.maximal_runs(line_dedup.sequences(docs, "doc_id", "text"), 2).collect()
    own = [t.split("\n") for t in texts]
    for r in got:
        a, b = own[r.doc][r.pos :], own[r.original.doc][r.original.pos :]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.original.doc, r.original.pos) < (r.doc, r.pos) and r.length == common >= 2
    found = {(r.doc, r.pos, r.length) for r in got}
    assert {(1, 1, 12), (1, 14, 3), (2, 0, 6), (2, 6, 12), (4, 0, 40)} <= found
    covered = {(r.doc, p) for r in got for p in range(r.pos, r.pos + r.length)}
    want, first = set(), {}
    for d, lines in enumerate(own):
        for p in range(len(lines) - 1):
            at = first.setdefault(tuple(lines[p : p + 2]), (d, p))
            if at[0] != d or p >= at[1] + 2:
                want |= {(d, p), (d, p + 1)}
    assert covered == want


def test_line_dedup_long_text(spark):
    """Many runs in one long document."""
    text = "\n".join(f"only {i}" if i % 3 else f"shared {i}\nnext {i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, "\n".join(f"shared {i}\nnext {i}\n" for i in range(0, 30_000, 6))), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_deduplicated(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 10_000 and len(got[2].removed_runs) == 5_000
    assert got[2].text == "\n".join(f"only {i}" if i % 3 else f"shared {i}\nnext {i}" for i in range(30_000) if i % 6)


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int")
    unlabelled = toxicity.toxicity(odd, labels).collect()
    assert len(unlabelled) == odd.count() and all(r.score == 0 and r.predicted == 0 and r.spans == [] for r in unlabelled)
    assert toxicity.toxicity(none, labels).count() == 0
    clean = [f"the {w} of a day number {i}" for i, w in enumerate(["light", "rain", "sun", "wind"] * 60)]
    rows = [(i, t if i % 3 else f"{t} you Grumblefool, {t}") for i, t in enumerate(clean)] + [(900, None), (901, ""), (902, LONG), (903, "what a grumblefool!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s"))
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(240))
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0 and got[903].predicted == 1
    span = got[903].spans[0]
    assert "what a grumblefool!"[span["start"] : span["end"]] == "grumblefool!"


def test_token_counts(spark, odd, none):
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(odd, *how).collect())
    for block in (1, 7, 64):  # documents run over many blocks, and end at their edges
        assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(odd.where("doc_id <> 6 or doc_id is null"), *how, block=block).collect()) == [x for x in whole if x[0] != 6]
    assert dict(whole)[3] == 0 and dict(whole)[4] == 0 and len(whole) == odd.count()
    assert token_counts.token_counts(none, *how).count() == 0


def test_mixing(spark, odd, none):
    got = mixing.mixed(odd).toPandas()
    assert len(got) == odd.count() and (got[got.doc_id == 3]["size"] == 0).all() and (got.taken <= 2 * got["size"]).all()
    assert got.source.isna().sum() == 1
    again = mixing.mixed(odd).toPandas()
    assert got.sort_values(["doc_id", "size"]).taken.tolist() == again.sort_values(["doc_id", "size"]).taken.tolist()
    assert mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0
    mix = mixing.mixture(odd)
    assert mix.columns == odd.columns
    once = "doc_id is null or doc_id <> 7"  # rows that repeat share what they are due
    words = mix.where(once).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == mixing.mixed(odd).where(once).agg(F.sum("taken")).first()[0]


def test_pipeline_stages(spark):
    """Each stage against a plain version of what it decides, on its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    told, equal, near, mix, _ = (f for _, f in corpus_pipeline.STAGES)
    one = told(spark, docs, "").cache()
    assert one.columns == docs.columns and one.count() == docs.where("text rlike '\\\\p{L}'").count()
    two = equal(spark, one, "").cache()
    last = one.toPandas().groupby("text").doc_id.max()
    assert sorted(r.doc_id for r in two.collect()) == sorted(last)
    three = near(spark, two, "").cache()
    prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in two.collect()}
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(plain_components(prints).values()))
    four = mix(spark, three, "").cache()
    due = {r.doc_id: r.taken for r in mixing.mixed(three).collect()}
    got = {}
    for r in four.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {d: n for d, n in due.items() if n} and four.columns == docs.columns
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() == len(got)


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none):
    """Nulls, repeated rows and clashing names pass through all stages; an empty table gives an empty result."""
    for docs in (none, odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, "")
            assert kept.columns == docs.columns, name
            docs = spark.createDataFrame(kept.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_digests_need_no_other_modules_imports():
    """A fresh worker has loaded only what the operator itself imports."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, spanlab.llm.chat; assert 'pyarrow.compute' in sys.modules"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
