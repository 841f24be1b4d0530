"""The learned models against independent versions: context trees by dictionaries, the random field by enumeration."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanlab.llm import language, toxicity


def ppm_bits(training, text, order=3):
    """Escape method C without exclusions, by dictionaries."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in training:
        b = b"\n" * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[k][b[i - k : i]][b[i]] += 1
    bits, b = 0.0, b"\n" * order + text
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            own = seen[k].get(b[i - k : i])
            if own:
                total = sum(own.values()) + len(own)
                if b[i] in own:
                    bits += math.log2(total / own[b[i]])
                    break
                bits += math.log2(total / len(own))
        else:
            bits += 8
    return bits


def trees(training, dense_bytes):
    langs = sorted(training)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x in langs for _ in training[x]]), pa.array([t for x in langs for t in training[x]], pa.binary())], ["lang", "text"])
    parts = pa.Table.from_batches(language._counted(iter([batch])))
    lang_of = np.array([langs.index(x) for x in parts.column("lang").to_pylist()])
    return language.build(parts.column("gram").to_numpy(), lang_of, parts.column("n").to_numpy().astype(float), langs, dense_bytes)


@pytest.mark.parametrize("dense_bytes", [1 << 30, 0])
def test_code_lengths_are_exact(dense_bytes):
    training = {"a": [b"the cat sat on the mat", b"a cat", "naïve café".encode()], "b": [b"der hund und die katze", b"und der mat", b"zzz"], "c": [b"cat"]}
    texts = ["the hund sat", "café und naïve Ω", "q", "zz the\n\ncat\t", "the cat sat on the mat " * 40]
    got = trees(training, dense_bytes).code_lengths([t.encode() for t in texts])
    want = [[ppm_bits(training[x], t.encode()) for x in sorted(training)] for t in texts]
    assert np.allclose(got, want, rtol=1e-12)


def test_languages_in_groups_score_alike(spark):
    """Tables of one language each give what tables of all give."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = language.identified(docs).orderBy("doc_id").collect()
    assert len([*language.fit(docs, F.lit(True), table_bytes=1)]) == 4 and len([*language.fit(docs, F.lit(True))]) == 1
    assert language.identified(docs, table_bytes=1).orderBy("doc_id").collect() == one
    assert language.in_known_language(docs, table_bytes=1).columns == docs.columns


def test_forward_backward_against_all_tag_sequences():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        emission, move = rng.normal(size=n), rng.normal(size=(2, 2))
        total, place, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=n):
            w = math.exp(sum(emission[t] for t in range(n) if tags[t]) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            place += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                moves[a, b] += w
        padded = np.append(emission, [3.0, -1.0])[None, :]
        p, m, z = toxicity.marginals(padded, np.array([n]), move)
        assert np.allclose(p[0, :n], place / total) and (p[0, n:] == 0).all() and np.allclose(m[0], moves / total) and math.isclose(z[0], math.log(total))


def test_quiet_chains_and_long_chains():
    move = np.array([[0.0, -0.4], [0.2, 1.5]])
    quiet = toxicity.Quiet(-2.0, move)
    for n in (1, 2, 700, 3):
        p, m, z = toxicity.marginals(np.full((1, n), -2.0), np.array([n]), move)
        got = quiet.of(n)
        assert np.allclose(got[0], p[0]) and np.allclose(got[1], m[0]) and math.isclose(got[2], z[0])
    # A line is one chain, however long: neighbours across any place are coupled.
    field = toxicity.Field({"=vile": 5.0}, -4.0, np.array([[0.0, 0.0], [0.0, 6.0]]))
    words = ["plain"] * 200
    words[63:65] = ["vile", "vile"]
    (best, spans), = field.tagged([" ".join(words)])
    emission = np.full((1, 200), -4.0)
    emission[0, 63:65] += 5.0
    p, _, _ = toxicity.marginals(emission, np.array([200]), field.move)
    assert math.isclose(best, p.max()) and [round(m, 9) for *_, m in spans] == [round(float(m), 9) for m in p[0] if m >= 0.5]


def test_tags_are_found_from_document_labels_and_neighbours_count():
    """One word is toxic only after another one: its word alone stands in clean documents as often."""
    rng = np.random.default_rng(2)
    filler = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(600):
        text = rng.choice(filler, 12).tolist()
        place = int(rng.integers(1, 10))
        text[place : place + 2] = ["you", "grub"] if i % 3 == 0 else ["you", str(rng.choice(filler))] if i % 3 == 1 else [str(rng.choice(filler)), "grub"] if i % 6 == 2 else text[place : place + 2]
        rows.append((" ".join(text), int(i % 3 == 0)))
    field = toxicity.fit_field(rows)
    assert field.weight.get("<you", 0) > 0.3 and field.weight.get("=grub", 0) > 0
    score = lambda t: field.score(field.tagged([t])[0][0])
    assert score("w1 w2 you grub w3") > 0.5 > max(score("w1 w2 w5 w3"), score("w1 w2 you w3"))


def test_held_out_toxicity_against_the_majority(spark):
    sf = "/root/testdata/sf0.1"
    got = __spark_entry__.queries()["op8_toxicity"](spark, sf).select("doc_id", "held_out", "predicted").toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").df()
    own = labels[[zlib.crc32(str(d).encode()) % 5 == 0 for d in labels.doc_id]]
    pred = got.predicted[own.doc_id].to_numpy()
    truth = own.toxic.to_numpy()
    assert got.held_out[own.doc_id].all()
    assert (pred == truth).mean() > max(truth.mean(), 1 - truth.mean()) + 0.05
    assert pred[truth == 1].mean() > 0.85 and pred[truth == 0].mean() < 0.02, (pred[truth == 1].mean(), pred[truth == 0].mean())
