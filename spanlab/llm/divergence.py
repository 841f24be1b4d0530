"""Source divergence audit: how the words of each source differ from its language and from the language's other sources.

Terms are runs of letters (ASCII letters and anything beyond ASCII), with only A to Z lower-cased; a language keeps the
terms that stand in at least `least_docs` of its documents, V of them. A group is what a source has in a language. With N
occurrences of kept terms, a term that occurs count times has p = 1 + floor(10^9 (count + 1) / (N + V)), in a group as in a
language. How far p is from q is f = floor((p - q)^2 / q). All arithmetic is of whole numbers.

Part `term`: a group's terms with count > 0 and p above the language's q, by f. This is an upper-bound search. Of a group,
the terms of a band of counts are a bucket; as f falls with q below p and grows with p, the highest p and the lowest q of a
bucket bound f for all its terms. Best first: buckets are opened in the order of their bounds until the opened ones hold
top_k terms, which gives the kth value; then every bucket that isn't strictly below it is opened too. What stays closed is
below the kth value for certain, so the result is exact, ties included.

Part `pair`: all pairs of a language's sources, f summed over all V terms. Terms that neither has are counted, not listed;
of terms that one of them has, f depends on its count only, so a group's numbers of terms by count do; only terms that both
have are compared, by postings: the sources of a term, with their counts.

Plans: documents are read once for terms and once for (lang, source) alone; occurrences are summed by tasks, in Arrow
batches, before any shuffle.
Postings are written, so lineage ends there. Joins on a group or language deal both sides by a salt too, as a hot source has
a share of all terms. Pairs of sources are the result's own size; they are summed before the shuffle.

Defined cases: null text, lang and source count as ''; repeated rows are documents each; a group without kept terms takes
part with counts of 0; a language without kept terms has pairs of value 0 and no terms; a language of one source has no
pairs; ties rank by UTF-8 bytes; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm._common import shuffle_partitions, written

SCALE = 1_000_000_000
#: Of UTF-8, what each byte becomes: ASCII letters in lower case, bytes of other characters as they are, anything else a space.
_BYTES = bytes(b if b >= 128 or bytes([b]).isalpha() else 32 for b in range(256)).lower()
#: Terms of groups that a task holds before it hands on their sums.
HELD = 400_000
GROUP = ["lang", "source"]


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact beyond 64 bits; null where nothing is kept."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of bigints: below 2^63, since both are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def salts_of(spark: SparkSession) -> int:
    """Enough that a group with a third of all rows is a small part of a task, few enough to hold a group once for each."""
    return min(shuffle_partitions(spark), 32)


def salted(rows: DataFrame, by: Column, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)))


def for_each_salt(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to partial sums (lang, source, term, n, in_docs); what is held is HELD terms of groups and a text."""
    counts: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in counts.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
            numbers = [pa.array(map(of.__getitem__, n), pa.int64()) for of in (n, in_docs)]
            yield pa.RecordBatch.from_arrays([*names, terms, *numbers], ["lang", "source", "term", "n", "in_docs"])
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            words = text.as_py().translate(_BYTES).split()
            n, in_docs = counts[lang, source]
            before = len(n)
            n.update(words)
            in_docs.update(set(words))
            held += len(n) - before
            if held >= HELD:
                yield from sums()
                held = 0
    yield from sums()


def postings(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int) -> DataFrame:
    """lang, term, source, n: occurrences of kept terms in each group that has them, and n_lang, those in the language."""
    filled = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*filled).mapInArrow(_counted, "lang string, source string, term string, n bigint, in_docs bigint")
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))
    lang = Window.partitionBy("lang", "term")
    rows = rows.withColumn("n_lang", F.sum("n").over(lang)).withColumn("docs_lang", F.sum("in_docs").over(lang))
    return rows.where(F.col("docs_lang") >= least_docs).select("lang", "term", "source", "n", "n_lang")


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Every group that occurs: total, total_lang (occurrences of kept terms) and kept (terms of the language), and p0, the p of
    a term that doesn't occur."""
    filled = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    every = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source")).distinct()
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    # A term is counted where its first source stands, so that terms need no shuffle of their own.
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count(F.lit(1)).alias("kept"))
    rows = every.join(own, GROUP, "left").join(terms, "lang", "left").fillna(0, ["total", "total_lang", "kept"])
    return rows.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("kept")))


def band(count: Column) -> Column:
    """Bands of counts: each count below 16 by itself, above eight bands to each doubling."""
    return F.when(count < 16, count).otherwise(16 + F.floor(8 * (F.log2(count.cast("double")) - 4)).cast("bigint"))


def top_terms(found: DataFrame, top_k: int) -> DataFrame:
    """found: lang, source, term, p, q, n, for p > q. The top_k terms of each group by f, by the search of the module."""
    rows = found.withColumn("band", band(F.col("n")))
    buckets = rows.groupBy(*GROUP, "band").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("terms"))
    buckets = buckets.withColumn("bound", distance(F.col("p"), F.col("q")))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "band")
    before = F.coalesce(F.sum("terms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = written(buckets.withColumn("first", before < top_k).select(*GROUP, "band", "bound", "first"), "divergence-buckets")
    salts = salts_of(rows.sparkSession)
    keys = [*GROUP, "band", "salt"]
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")

    def opened(chosen: DataFrame) -> DataFrame:
        some = salted(rows, F.col("term"), salts).join(for_each_salt(chosen.select(*GROUP, "band"), salts), keys)
        values = some.select(*GROUP, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        return values.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)

    first = written(opened(buckets.where("first")), "divergence-first")
    kth = first.where(F.col("rank") == top_k).select(*GROUP, F.col("value").alias("kth"))
    later = buckets.where("NOT first").join(kth, GROUP, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    both = first.drop("rank").unionByName(opened(later).drop("rank"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of a language's sources. kept has p of each posting.

    With a the p0 of the source and b that of the item, the sum over all kept terms is kept f(a, b), plus f(p, b) - f(a, b)
    for each term of the source, plus f(a, q) - f(a, b) for each term of the item, plus, for each term that both have, what
    f(p, q) has beyond these.
    """
    salts = salts_of(kept.sparkSession)
    own = groups.select("lang", "source", "kept", F.col("p0").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b"))
    pairs = salted(own, F.col("source"), salts).join(for_each_salt(other, salts), ["lang", "salt"]).where(F.col("source") != F.col("item"))
    pairs = pairs.select("lang", "source", "item", "kept", "a", "b")
    a, b = F.col("a"), F.col("b")
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("kept") * distance(a, b), F.lit(0)).alias("value"))
    # Numbers of terms by count stand for the terms of one of the two.
    histogram = kept.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    spread = salted(histogram, F.struct("source", "p"), salts)
    sides = for_each_salt(groups.select("lang", F.col("source").alias("with"), F.col("p0").alias("p0_with")), salts)
    met = spread.join(sides, ["lang", "salt"]).where(F.col("source") != F.col("with"))
    p, mine, theirs = F.col("p"), F.col("p0"), F.col("p0_with")
    as_source = met.select("lang", "source", F.col("with").alias("item"), (F.col("terms") * (distance(p, theirs) - distance(mine, theirs))).alias("value"))
    as_item = met.select("lang", F.col("with").alias("source"), F.col("source").alias("item"), (F.col("terms") * (distance(theirs, p) - distance(theirs, mine))).alias("value"))
    # Each pair of sources that share a term once, with both directions' sums, before any shuffle of pairs.
    one = kept.select("lang", "term", F.col("source").alias("s"), "p", F.col("p0").alias("a"))
    two = kept.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("q"), F.col("p0").alias("b"))
    beyond = lambda p, q, a, b: F.sum(distance(p, q) - distance(p, b) - distance(a, q) + distance(a, b))
    sums = one.join(two, ["lang", "term"]).where(F.col("s") < F.col("t")).groupBy("lang", "s", "t")
    q = F.col("q")
    sums = sums.agg(beyond(p, q, a, b).alias("st"), beyond(q, p, b, a).alias("ts"))
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    both = sums.select("lang", F.inline(F.array(way("s", "t", "st"), way("t", "s", "ts"))))
    parts = base.unionByName(as_source).unionByName(as_item).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top_k: int = 200
) -> DataFrame:
    """lang, source, part, item, value, rank: `term` to rank top_k and all of `pair`, each from 1 in each group."""
    kept = written(postings(docs, text_col, lang_col, source_col, least_docs), "divergence-postings")
    groups = written(groups_of(docs, kept, lang_col, source_col), "divergence-groups")
    salts = salts_of(docs.sparkSession)
    rows = salted(kept, F.col("term"), salts).join(for_each_salt(groups, salts), [*GROUP, "salt"]).drop("salt")
    rows = rows.withColumn("p", probability(F.col("n"), F.col("total"), F.col("kept")))
    rows = rows.withColumn("q", probability(F.col("n_lang"), F.col("total_lang"), F.col("kept")))
    rows = written(rows.select("lang", "source", "term", "n", "p", "q", "p0"), "divergence-probabilities")
    terms = top_terms(rows.where(F.col("p") > F.col("q")).drop("p0"), top_k)
    ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    pairs = pair_values(rows, groups).withColumn("rank", ranked)
    labelled = lambda rows, part: rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return labelled(terms, "term").unionByName(labelled(pairs, "pair"))
