"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order is counted (PPM, escape method C, no exclusions): the code length
of a byte is that of the longest known context, after an escape from each longer context that knows other bytes only. The
trees are frozen and laid out as tables over all languages, so the exact code lengths of a whole text under every language
are sums of table look-ups. The prediction is the language with the shortest code, the score its posterior probability
with equal priors.

Trees are fitted on a sample of `sample_docs` labelled documents of each language at most (chosen by a hash of the
identifier, whole texts; this bounds the labelled rows, and no context of theirs is left out); scoring reads every text
whole, in pieces of bounded size. Languages are dealt into groups whose tables take about `table_bytes` each at most, and
every text is scored by one group after the other, so neither the driver nor a worker holds more than one group's tables,
however many languages there are. A group's context runs are looked up in a dense table where that is small and by binary
search where it isn't; both give the same, exact lengths.

Defined cases: a text that is null, empty or has no letter is `und` with score 0; so is every text if nothing could be
learned. Rows without identifier or language teach nothing. Ties go to the first language by code point. Repeated rows
count as often as they stand. Columns with whatever names are carried untouched by `in_known_language`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from spanlab.llm._common import fresh_name, written

UND = "und"
#: Contexts have this many bytes at most. A text's first bytes follow upon that many line ends.
ORDER = 3
_PAD = b"\n" * ORDER
_PIECE = 1 << 19
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Runs of four bytes are looked up in a dense table up to this size.
DENSE_BYTES = 64 << 20


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def _grams(text: bytes) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number."""
    b = np.frombuffer(_PAD + text, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for at in range(0, len(own), 256):
                grams, count = np.unique(np.concatenate([_grams(t) for t in own[at : at + 256]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(count)], ["lang", "gram", "n"])


@dataclass(frozen=True)
class Trees:
    """Frozen trees of all languages. symbol: byte to its class (0: never seen in training). Tables by number of context."""

    langs: list[str]
    symbol: np.ndarray
    third: np.ndarray  # class triple -> number of the three-byte context, 0 if unknown
    fourth: np.ndarray | None  # (context, class) -> row of seen, 0 if never seen; None where that would be large
    runs: np.ndarray  # the keys (context, class) of the rows of seen from 1 on, ascending
    seen: np.ndarray  # rows of code lengths by language, of seen four-byte runs
    escape: np.ndarray  # by three-byte context: what leaving it costs
    shorter: np.ndarray  # by number of three-byte run: cost of its last byte after its first two
    escape2: np.ndarray  # by class pair
    pair: np.ndarray  # (class, class): cost of the second after the first, escapes included

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (none empty) under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[bytes] = []
        owner: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), _PIECE):
                held.append((_PAD if at == 0 else t[at - ORDER : at]) + t[at : at + _PIECE])
                owner.append(i)
                size += len(held[-1])
                if size >= _PIECE:
                    np.add.at(out, owner, self._sums(held))
                    held, owner, size = [], [], 0
        if held:
            np.add.at(out, owner, self._sums(held))
        return out

    def _row(self, keys: np.ndarray) -> np.ndarray:
        if self.fourth is not None:
            return self.fourth[keys]
        at = np.minimum(np.searchsorted(self.runs, keys), len(self.runs) - 1)
        return np.where(self.runs[at] == keys, at + 1, 0)

    def _sums(self, pieces: list[bytes]) -> np.ndarray:
        """Of pieces that begin with their context."""
        many = len(self.third) and round(len(self.third) ** (1 / 3))
        s = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = s[:-1] * many + s[1:]
        run = self.third[pair[:-1] * many + s[2:]]  # run[k] ends at k + 2
        row = self._row(run[:-1].astype(np.int64) * many + s[3:])  # row[k] ends at k + 3
        cost = self.seen[row]
        lost = np.flatnonzero(row == 0)
        if len(lost):
            inner = run[lost + 1]
            less = self.shorter[inner]
            unknown = inner == 0
            deep = lost[unknown]
            less[unknown] = self.escape2[pair[deep + 1]] + self.pair[pair[deep + 2]]
            cost[lost] = self.escape[run[lost]] + less
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.append(0, ends[:-1])
        # A piece's own bytes begin ORDER after its start, as those before are context: bounds alternate own, context.
        bounds = np.empty(2 * len(pieces), np.int64)
        bounds[0::2], bounds[1::2] = starts, ends - ORDER
        bounds = bounds[:-1]
        return np.add.reduceat(cost, bounds, axis=0, dtype=np.float64)[0::2]


def build(grams: np.ndarray, lang_of: np.ndarray, count: np.ndarray, langs: list[str], dense_bytes: int = DENSE_BYTES) -> Trees:
    """grams: four-byte runs with their count in a language (an index into langs)."""
    n_lang = len(langs)
    symbol = np.zeros(256, np.int32)
    bytes_seen = np.unique(np.concatenate([grams >> 24 & 255, grams >> 16 & 255, grams >> 8 & 255, grams & 255]))
    symbol[bytes_seen.astype(int)] = np.arange(1, len(bytes_seen) + 1)
    many = len(bytes_seen) + 1
    s = [symbol[(grams >> k & 255).astype(int)].astype(np.int64) for k in (24, 16, 8, 0)]

    def table(context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs (context, last) and, by language, -log2 of a seen byte's share; distinct contexts and their escape."""
        key = context * many + last
        runs, at = np.unique(key, return_inverse=True)
        n = np.zeros((len(runs), n_lang))
        np.add.at(n, (at, lang_of), count)
        contexts, of = np.unique(runs // many, return_inverse=True)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(n > 0, np.log2(total + kinds)[of] - np.log2(n), np.nan)
            leave = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
        return runs, own, contexts, leave, of

    base = np.full(n_lang, 8.0)  # below all contexts every byte has the same code
    zero = np.zeros(len(grams), np.int64)
    runs1, own1, _, leave1, _ = table(zero, s[3])
    single = np.tile(base + (leave1[0] if len(leave1) else 0), (many, 1))
    single[runs1] = np.where(np.isnan(own1), single[runs1], own1)
    runs2, own2, contexts2, leave2, of2 = table(s[2], s[3])
    first = np.zeros((many, n_lang))
    first[contexts2] = leave2
    pair = (first[:, None, :] + single[None, :, :]).reshape(many * many, n_lang)
    pair[runs2] = np.where(np.isnan(own2), pair[runs2], own2)
    runs3, own3, contexts3, leave3, of3 = table(s[1] * many + s[2], s[3])
    escape2 = np.zeros((many * many, n_lang))
    escape2[contexts3] = leave3
    shorter3 = np.where(np.isnan(own3), leave3[of3] + pair[(runs3 // many) % many * many + runs3 % many], own3)
    triples = np.unique(np.concatenate([runs3, (s[0] * many + s[1]) * many + s[2]]))
    third = np.zeros(many**3, np.int32)
    third[triples] = np.arange(1, len(triples) + 1)
    first2, rest = triples // many, (triples // many) % many * many + triples % many
    shorter = np.zeros((len(triples) + 1, n_lang))
    shorter[1:] = escape2[first2] + pair[rest]
    shorter[third[runs3]] = shorter3
    runs4, own4, contexts4, leave4, of4 = table((s[0] * many + s[1]) * many + s[2], s[3])
    escape = np.zeros((len(triples) + 1, n_lang))
    escape[third[contexts4]] = leave4
    inner = third[runs4 % many**3]
    seen = np.zeros((len(runs4) + 1, n_lang))
    seen[1:] = np.where(np.isnan(own4), leave4[of4] + shorter[inner], own4)
    runs = third[runs4 // many].astype(np.int64) * many + runs4 % many
    fourth = None
    if (len(triples) + 1) * many * 4 <= dense_bytes:
        fourth = np.zeros((len(triples) + 1) * many, np.int32)
        fourth[runs] = np.arange(1, len(runs) + 1)
    return Trees(langs, symbol, third, fourth, runs, seen, escape, shorter, escape2, pair)


def language_groups(grams: dict[str, int], table_bytes: int) -> list[list[str]]:
    """Languages in order of code point, cut where the tables of a group (grams times languages, eight bytes each) grow too
    large; a language alone may."""
    out: list[list[str]] = []
    held = 0
    for lang in sorted(grams):
        if not out or (held + grams[lang]) * (len(out[-1]) + 1) * 8 > table_bytes:
            out.append([])
            held = 0
        out[-1].append(lang)
        held += grams[lang]
    return out


def fit(
    docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 2000,
    table_bytes: int = 256 << 20, seed: int = 5,
) -> Iterator[Trees]:
    """From the rows for which learn holds: the trees of each group of languages, one group at a time; none if there are none."""
    rows = docs.where(F.coalesce(learn, F.lit(False)) & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = rows.select(docs[lang_col].alias("lang"), docs[text_col].alias("text"), docs[id_col].alias("id"))
    totals = written(rows.groupBy("lang").count(), "language-totals")
    few = totals.count() <= 100_000  # languages, a row each
    modulus = 1 << 30
    totals = totals.withColumn("most", F.least(F.lit(modulus), F.lit(modulus * float(sample_docs)) / F.col("count")).cast("long")).select("lang", "most")
    taken = rows.join(F.broadcast(totals) if few else totals, "lang").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(modulus)) < F.col("most")).select("lang", "text")
    counts = taken.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-counts")
    grams = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    for langs in language_groups(grams, table_bytes):
        own = counts.where(F.col("lang").isin(langs)).toArrow()
        number = {x: i for i, x in enumerate(langs)}
        lang_of = np.array([number[x] for x in own.column("lang").to_pylist()])
        yield build(own.column("gram").to_numpy(), lang_of, own.column("n").to_numpy().astype(float), langs)


def _lengths(shared, text: int, before: int | None):
    """Adds the code lengths of a group to each row's list of them, the last column: empty for a text without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            use = [i for i, t in enumerate(texts) if has_letter(t)]
            own: list[list[float]] = [[]] * len(texts)
            for i, bits in zip(use, model.code_lengths([texts[i] for i in use]).tolist() if use else ()):
                own[i] = bits
            columns, names = batch.columns, batch.schema.names
            if before is not None:
                own = [a + b for a, b in zip(batch.column(before).to_pylist(), own)]
                columns, names = columns[:before], names[:before]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.list_(pa.float64()))], [*names, "bits"])

    return run


def predicted(docs: DataFrame, text_col: str, models: Iterator[Trees]) -> tuple[DataFrame, Column, Column]:
    """docs with a last column more, and the columns of the language and the score that follow from that."""
    spark, schema = docs.sparkSession, StructType(docs.schema.fields)
    places, langs, out = docs.columns.index(text_col), [], docs
    bits = fresh_name("bits", docs.columns)
    for k, model in enumerate(models):
        langs += model.langs
        made = StructType([*schema.fields, StructField(bits, ArrayType(DoubleType()))])
        out = out.mapInArrow(_lengths(spark.sparkContext.broadcast(model), places, len(schema) if k else None), made)
    if not langs:
        return docs, F.lit(UND), F.lit(0.0)
    told, least = F.size(out[bits]) > 0, F.array_min(out[bits])
    lang = F.when(told, F.element_at(F.array(*map(F.lit, langs)), F.array_position(out[bits], least).cast("int"))).otherwise(UND)
    weights = F.aggregate(out[bits], F.lit(0.0), lambda total, b: total + F.pow(F.lit(2.0), F.greatest(least - b, F.lit(-1000.0))))
    return out, lang, F.when(told, 1 / weights).otherwise(0.0)


def learnable(id_col: Column) -> Column:
    """Documents to learn from: the CRC-32 of the identifier as text isn't 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(3)) != 1, F.lit(False))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """One row for each document: its identifier, held_out, lang_pred and score."""
    models = fit(docs, learnable(docs[id_col]), text_col, lang_col, id_col, **how)
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(docs[id_col].cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(docs[id_col].alias("id"), held_out.alias("held_out"), docs[text_col].cast("string").alias("text"))
    out, lang, score = predicted(rows, "text", models)
    return out.select(F.col("id").alias(id_col), "held_out", lang.alias("lang_pred"), score.alias("score"))


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5, **how) -> DataFrame:
    """The rows of docs whose language is told with a score of least_score or more."""
    out, lang, score = predicted(docs, text_col, fit(docs, learnable(docs[id_col]), text_col, lang_col, id_col, **how))
    return out.where((lang != UND) & (score >= least_score)).select(*[out[c] for c in docs.columns])
