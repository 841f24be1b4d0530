"""Line deduplication with a suffix array over line identifiers, in DataFrame functions only.

A document is the sequence of its lines that hold more than white space; a line's identifier is a digest of its text. The
suffixes of all sequences are sorted by prefix doubling: ranks by the first line, then by the first two, four and so on
lines, each round ranking pairs of the last round's ranks, until every suffix is settled: one whose prefix is unique, or
that has fewer lines than the prefix, leaves. Ranks are sums over distinct pairs, taken in range buckets that follow from
the last ranks, so a line that is a third of all rows is one row of that sum; its rank comes to its rows by a broadcast of
the frequent ones (`joined_by_frequency`).

Suffixes of equal rank at a depth are an interval of the suffix array whose common prefix is that deep or deeper. The first
of an interval in document order is its original, the others are copies; a window that overlaps its original isn't one. A
copy is set against the original of the deepest interval in which it is a copy, and their longest common prefix follows
from the ranks of all depths, taken downwards from that of the interval. Copies that no other copy's prefix covers are the
maximal repeated runs (`maximal_runs`); those of `min_lines` lines or more are deleted. A single line of `min_words` words
or more is long enough for a run by itself.

A copy is always of lines that stand earlier (by identifier, then line), so each deleted line is left somewhere.

Defined cases: a null text has no lines and stays null; lines of white space are never deleted; rows that repeat both
identifier and text are one document, with the result on each; a null identifier comes before all others; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm._common import joined_by_frequency, shuffle_partitions, word_count, written

#: Documents that differ in identifier or text.
DOC = ["doc", "text_key"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line that isn't blank: doc, text_key, pos (from 0, blank lines not counted), line_no, line, words."""
    line = F.transform(_lines(docs[text_col]), lambda x, i: F.struct(i.alias("line_no"), x.alias("x")))
    full = F.filter(line, lambda s: s["x"].rlike(r"[^\s\p{Z}]"))
    # The key and the lines stand in a row of their own below the generator, so that the text isn't carried with each line.
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col], F.length(docs[text_col])).alias("text_key"), full.alias("lines"))
    rows = rows.select(*DOC, F.posexplode("lines").alias("pos", "s"))
    return rows.select(*DOC, "pos", F.col("s.line_no").alias("line_no"), F.unhex(F.md5(F.encode("s.x", "UTF-8"))).alias("line"), word_count(F.col("s.x")).alias("words")).distinct()


def _ranked(keys: DataFrame, by: list[str], where: Column, buckets: int) -> DataFrame:
    """keys: distinct, with n rows each. Adds place, the number of rows below. where: the range bucket, monotone in by."""
    keys = written(keys.withColumn("bucket", where.cast("int")), "suffix-keys")
    inner = Window.partitionBy("bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = keys.groupBy("bucket").agg(F.sum("n").alias("size"))  # at most buckets rows
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    out = keys.join(F.broadcast(before), "bucket")
    return out.withColumn("place", F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("before")).drop("bucket", "before")


def _at(doc: str, key: str, pos: Column, ranks: DataFrame, out: str) -> tuple[DataFrame, Column]:
    """ranks under names of its own, and the condition that joins it at a place."""
    side = ranks.select(F.col("doc").alias(f"_{out}_doc"), F.col("text_key").alias(f"_{out}_key"), F.col("pos").alias(f"_{out}_pos"), F.col("rank").alias(out))
    return side, F.col(doc).eqNullSafe(F.col(f"_{out}_doc")) & (F.col(key) == F.col(f"_{out}_key")) & (pos == F.col(f"_{out}_pos"))


def suffix_levels(lines: DataFrame, min_lines: int, doubled: bool = True) -> list[tuple[int, DataFrame]]:
    """Depths, ascending, each with the suffixes whose first `depth` lines stand elsewhere too: doc, text_key, pos, rank, n.
    Equal ranks: equal prefixes, n of them. The depths are 1, 2, 4 and so on, with min_lines among them and doubled from
    there until no suffix is left; without `doubled` they end at min_lines."""
    buckets = 4 * shuffle_partitions(lines.sparkSession)
    first = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Digests are spread evenly, so their leading bits are range buckets.
    leading = F.conv(F.substring(F.hex("line"), 1, 8), 16, 10).cast("double") / (1 << 32) * buckets
    ranks = _ranked(first, ["line"], F.floor(leading), buckets)
    total, depth, out = max(1, lines.count()), 1, []
    state = written(joined_by_frequency(lines, ranks, ["line"], "n", total).select(*DOC, "pos", F.col("place").alias("rank"), "n"), "suffix-ranks")
    while not state.isEmpty():
        out.append((depth, state))
        if depth >= min_lines and not doubled:
            break
        step = min(depth, min_lines - depth) if depth < min_lines else depth  # two windows may overlap, so any depth is met
        side, same = _at("doc", "text_key", F.col("pos") + step, state, "next")
        pairs = written(state.join(side, same).select(*DOC, "pos", "rank", "n", "next"), "suffix-pairs")
        if pairs.isEmpty():
            break
        keys = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("span")).where("m > 1").withColumnRenamed("m", "n")
        # A rank's rows fill the next `span` ranks; the second rank tells where among them a pair stands.
        at = (F.col("rank") + F.col("span") * F.col("next") / F.lit(float(total))) / F.lit(float(total)) * buckets
        found = _ranked(keys, ["rank", "next"], F.least(F.floor(at), F.lit(buckets - 1)), buckets)
        state = written(joined_by_frequency(pairs.drop("n"), found.drop("span"), ["rank", "next"], "n", total).select(*DOC, "pos", F.col("place").alias("rank"), "n"), "suffix-ranks")
        depth += step
    return out


def copies(suffixes: DataFrame, depth: int) -> DataFrame:
    """Windows of `depth` lines that copy an earlier one: doc, text_key, pos, original (doc, text_key, pos)."""
    place = F.struct(*DOC, "pos")
    # Written first: else the join would stand on the sum's own partitions, and a frequent rank couldn't be split.
    least = written(suffixes.groupBy("rank").agg(F.min(place).alias("original")), "originals")
    joined = suffixes.join(least, "rank")
    own = F.col("original.doc").eqNullSafe(F.col("doc")) & (F.col("original.text_key") == F.col("text_key"))
    return joined.where(~(own & (F.col("pos") < F.col("original.pos") + depth))).select(*DOC, "pos", "original")


def copied_prefixes(lines: DataFrame, min_lines: int) -> DataFrame:
    """Of each suffix that copies min_lines lines or more: doc, text_key, pos, original, and length, the longest common
    prefix with its original."""
    levels = suffix_levels(lines, min_lines)
    deep = [(depth, copies(state, depth)) for depth, state in levels if depth >= min_lines]
    if not deep:
        return lines.where("false").select(*DOC, "pos", F.struct(*DOC, "pos").alias("original"), F.lit(0).alias("length"))
    rows = None
    for depth, found in deep:
        own = found.withColumn("best", F.struct(F.lit(depth).alias("length"), "original")).select(*DOC, "pos", "best")
        rows = own if rows is None else rows.unionByName(own)
    if len(deep) > 1:
        rows = rows.groupBy(*DOC, "pos").agg(F.max_by("best", "best.length").alias("best"))
    rows = rows.select(*DOC, "pos", "best.original", "best.length")
    # Within a document the prefix may run into the copy itself, so it is measured from the longest depth down.
    own = F.col("original.doc").eqNullSafe(F.col("doc")) & (F.col("original.text_key") == F.col("text_key"))
    rows = rows.withColumn("interval", F.when(own, F.lit(1 << 30)).otherwise(F.col("length"))).withColumn("length", F.when(own, 0).otherwise(F.col("length")))
    for depth, state in reversed(levels):
        rows = written(rows, "copied-prefixes")
        odd = rows.where(F.col("interval") > depth).withColumns({"o_doc": F.col("original.doc"), "o_key": F.col("original.text_key")})
        here, at_here = _at("doc", "text_key", F.col("pos") + F.col("length"), state, "own_rank")
        there, at_there = _at("o_doc", "o_key", F.col("original.pos") + F.col("length"), state, "other_rank")
        longer = odd.join(here, at_here).join(there, at_there).where("own_rank = other_rank")
        longer = longer.select(*DOC, "pos", F.lit(depth).alias("more"))
        side = longer.select(*[F.col(c).alias(f"_{c}") for c in (*DOC, "pos")], "more")
        same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text_key")) & (F.col("pos") == F.col("_pos"))
        rows = rows.join(side, same, "left").select(*DOC, "pos", "original", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), "interval")
    return rows.drop("interval")


def maximal_runs(lines: DataFrame, min_lines: int = 2) -> DataFrame:
    """The copied prefixes that no earlier one of their document covers: doc, text_key, pos, original, length. Rows of one
    original and length are the copies of one interval."""
    rows = copied_prefixes(lines, min_lines)
    before = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("pos") + F.col("length")).over(before), F.lit(0))
    return rows.withColumn("_reached", reached).where("pos + length > _reached").drop("_reached")


def deleted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """doc, text_key, runs: array of (first, last) line numbers, from 0 and sorted, of the lines to delete."""
    lines = written(sequences(docs, id_col, text_col), "lines")
    runs = maximal_runs(lines, min_lines).select(*DOC, F.explode(F.sequence("pos", F.col("pos") + F.col("length") - 1)).alias("pos"))
    long = [copies(state, 1) for _, state in suffix_levels(lines.where(F.col("words") >= min_words), 1, doubled=False)]
    for found in long:
        runs = runs.unionByName(found.select(*DOC, "pos"))
    gone = runs.distinct().select(*[F.col(c).alias(f"_{c}") for c in (*DOC, "pos")])
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text_key")) & (F.col("pos") == F.col("_pos"))
    gone = lines.select(*DOC, "pos", "line_no").join(gone, same, "left_semi")
    order = Window.partitionBy(*DOC).orderBy("pos")
    gone = gone.withColumn("island", F.col("pos") - F.row_number().over(order))
    islands = gone.groupBy(*DOC, "island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    return islands.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def line_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """The rows of docs with the deleted lines cut from their text, and removed_runs, n_lines, n_removed added."""
    runs = deleted_runs(docs, id_col, text_col, min_lines, min_words).select(F.col("doc").alias("_line_doc"), F.col("text_key").alias("_line_key"), F.col("runs").alias("_line_runs"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_line_row"), docs[id_col].alias("_line_id"), docs[text_col].alias("_line_text"))
    key = F.xxhash64("_line_text", F.length("_line_text"))
    rows = rows.join(runs, F.col("_line_id").eqNullSafe(F.col("_line_doc")) & (key == F.col("_line_key")), "left")
    runs_of = F.coalesce("_line_runs", F.array().cast("array<struct<first:int,last:int>>"))
    rows = rows.withColumn("_line_gone", runs_of).withColumn("_line_all", _lines(F.col("_line_text")))
    # A run's lines are cut out as slices between runs, so a document is gone through once, whatever its number of runs.
    blank = lambda x: ~x.rlike(r"[^\s\p{Z}]")
    run_lines = lambda r: F.slice("_line_all", r["first"] + 1, r["last"] - r["first"] + 1)
    begin = lambda i: F.when(i > 0, F.get("_line_gone", i - 1)["last"] + 1).otherwise(0)
    between = F.transform("_line_gone", lambda r, i: F.concat(F.slice("_line_all", begin(i) + 1, r["first"] - begin(i)), F.filter(run_lines(r), blank)))
    end = begin(F.size("_line_gone"))
    rest = F.slice("_line_all", end + 1, F.size("_line_all") - end)
    cut = F.array_join(F.concat(F.flatten(between), rest), "\n")
    removed = F.aggregate("_line_gone", F.lit(0), lambda n, r: n + F.size(F.filter(run_lines(r), lambda x: ~blank(x))))
    some = F.size("_line_gone") > 0
    kept = F.when(F.col("_line_text").isNotNull(), F.when(some, cut).otherwise(F.col("_line_text")))
    columns = [(kept if c == text_col else F.col("_line_row").getField(c)).alias(c) for c in docs.columns]
    total = F.when(F.col("_line_text").isNull(), 0).otherwise(F.size("_line_all"))
    return rows.select(*columns, F.col("_line_gone").alias("removed_runs"), total.alias("n_lines"), F.when(some, removed).otherwise(0).alias("n_removed"))
