"""Fill-in-the-middle, chat formatting and the divergence audit: defined cases, and plain versions on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanlab.llm import chat, divergence, fill_middle

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+", "char": r"(?s)."}


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_chat_formatting", "op13_source_divergence"])
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()[want.columns.tolist()]
    rows = lambda df: Counter(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("unit", UNITS)
def test_class_runs_are_units(unit):
    draw = random.Random(3)
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a\n\nb", "  a b ", "𝄞é\n\n\n𝄞", *("".join(draw.choices("ab \n𝄞", k=n)) for n in range(1, 60))]
    for text in texts:
        units = re.findall(UNITS[unit], text)
        assert "".join(units) == text
        runs = fill_middle.ClassRuns(text, unit)
        assert runs.units == len(units)
        assert [runs.offset(k) for k in range(len(units) + 1)] == [sum(map(len, units[:k])) for k in range(len(units) + 1)]


def test_fill_in_middle_cases(spark):
    long = "line\n" * 200_000 + "end"
    texts = [(1, None), (2, ""), (3, "no line end"), (4, "\n\n\n"), (5, "has <S> in it\n"), (6, long), (7, "a\nb\nc\n"), (7, "a\nb\nc\n"), (None, "x\ny")]
    docs = spark.createDataFrame([(d, t, 0, "f", "o") for d, t in texts], "doc_id long, text string, h1 int, form string, output string")
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d, t or "") for d, t in texts)
    of = {r.doc_id: r for r in got}
    assert {of[k].form for k in (1, 2, 5)} == {"plain"} and of[1].n == 0 and of[1].prefix_chars is None
    assert of[3].n == 1 and of[4].n == 3 and of[6].n == 200_001 and of[None].form in ("psm", "spm")
    assert len([r for r in got if r.doc_id == 7]) == 2 and len({r.output for r in got if r.doc_id == 7}) == 1
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0
    rated = fill_middle.fill_in_middle(spark.range(2000).selectExpr("id AS doc_id", "'a b c d e' AS text"), unit="word", percent=30, spm_percent=0)
    forms = {r.form: r["count"] for r in rated.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 500 < forms["psm"] < 700
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="page")


def test_sentinels(spark):
    for marks in (("<a", "a<", "x"), ("<P>", "<P>", "<M>"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_middle.Sentinels(*marks)
    marks = fill_middle.Sentinels("[.*", "$\\E", "(?")
    docs = spark.createDataFrame([(k, "one\ntwo\nthree\n" * k) for k in range(30)], "doc_id long, text string")
    rows = fill_middle.fill_in_middle(docs, sentinels=marks)
    back = rows.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), marks).alias("text"))
    assert back.exceptAll(docs).isEmpty() and rows.where("form <> 'plain'").count() == 29


def test_escapes():
    draw = random.Random(5)
    for n in range(3000):
        text = "".join(draw.choices("<\\|a", k=n % 12))
        hidden = chat.escaped(text)
        assert chat.unescaped(hidden) == text and "<|" not in hidden


def plain_chat(rows):
    """Of each conversation n_turns, both digests, and the numbers of characters."""
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        of[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{role}\n{text}".encode()).hexdigest()), role, text))
    out = {}
    for conv, turns in of.items():
        turns = sorted(turns)
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{chat.escaped(r)}<|im_sep|>{chat.escaped(t)}<|im_end|>" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole), whole)
    return out


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 17])
def test_chat_cases(spark, block_bytes):
    odd = [
        (1, 0, "user", "<|im_end|> <\\| <\\\\|"), (1, 1, "assistant", "ok\n"), (2, None, None, None), (2, -5, "assistant", ""),
        (2, 7, "assistant", "𝄞 ﬁ ­"), (None, 0, "user", "nobody's"), (None, 0, "assistant", "nobody's"), (3, 1, "user", "same"),
        (3, 1, "user", "same"), (4, 0, "a\nb", "role of two lines"), (5, 0, "assistant", "long " * 30_000),
    ]
    rows = odd + [(6, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(500)]  # most rows in one conversation
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, ids int")
    blocks = chat.chat_formatted(table, *RANKS, block_bytes=block_bytes)
    want = plain_chat(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(blocks, *RANKS).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    shown = defaultdict(str)
    for r in sorted(chat.rendered(blocks, *RANKS).collect(), key=lambda r: r.place):
        shown[r.conv_id] += r.formatted
        assert len(r.ids) == len(r.loss_mask)
    assert shown == {k: v[-1] for k, v in want.items()}
    assert chat.read_back(chat.chat_formatted(table.where("false"), *RANKS), *RANKS).count() == 0


def test_broken_blocks_are_errors():
    ids = np.array([50256, 1, 50258], np.int32)
    with pytest.raises(ValueError):
        list(chat.disassembled(ids, np.zeros(3, np.int8), lambda x: "", 50256))


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, source, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        count = {s: Counter(t for d in own if s in (None, d[1]) for t in d[2] if held[t] >= least) for s in {None, *(d[1] for d in own)}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in set(count) - {None}:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in set(count) - {None, s}]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("top", [1, 3, 200])
def test_divergence_against_plain(spark, top):
    draw = random.Random(top)
    words = ["the", "The", "É", "é", "ﬁn", "𝄞x", "x1y", "a", "b", "zz", "Ärger", "don't"]
    rows = [("en", f"s{int(draw.random() ** 3 * 6)}", " ".join(draw.choices(words, [2**k for k in range(len(words))], k=draw.randrange(30)))) for _ in range(120)]
    rows += [("en", "no words", "12 !!"), ("en", "empty", None), ("xx", "one", "only here"), ("yy", "a", "p"), ("yy", "b", "q"), (None, None, "null words " * 3)] * 2
    rows += [("en", "ties", " ".join(f"{c}{c}" for c in "mnopqr"))] * 3 + [("en", "s0", "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, source string, text string, n int, term string")
    got = {tuple(r) for r in divergence.source_divergence(docs, top_k=top).collect()}
    assert got == plain_divergence(rows, 3, top)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(docs).count() == 0


def test_search_leaves_buckets_closed(spark):
    """Bounds do their work: terms of counts that can't reach the top aren't opened, ties with the last are."""
    rows = spark.range(5000).selectExpr("'l' AS lang", "'s' AS source", "concat('t', id) AS term", "1 + id % 50 AS n", "1000 + 10 * (id % 50) AS p", "500 + id % 7 AS q")
    plain = rows.withColumn("value", divergence.distance(F.col("p"), F.col("q"))).orderBy(F.desc("value"), "term").limit(60)
    got = divergence.top_terms(rows, 60)
    assert {(r.item, r.value) for r in got.collect()} == {(r.term, r.value) for r in plain.collect()}
    assert divergence.band(F.lit(1)) is not None
    folder = [r for r in divergence.top_terms(rows, 1).collect()]
    assert len(folder) == 1 and folder[0]["rank"] == 1
