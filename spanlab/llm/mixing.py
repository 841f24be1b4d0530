"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Sizes are word counts. Every source gets a target: its weight's share of the mix, cut at `most_passes` times its own size,
the excess shared again by weight until no target is above. The mix is a number of equal blocks of words, `blocks` at
least and as many more as the smallest target needs to hold `source_blocks` of them; they go to sources by the highest
quotients target / (2 s + 1). The words of a source's blocks go to its shards (a seeded hash of the document) in the same
way, so every shard has a quota of whole words, and none is lost to a block that a shard doesn't fill. In a shard the
documents stand in a seeded order, which makes its words one stream; the quota takes the stream a whole number of times
and, for what is left over, a run of neighbouring words that starts at a seeded place and may wrap round. So at most two
documents of a shard are taken in part.

Plan at scale: a source has `shards` shards or, if those are more, one for each `shard_words` words, so a source that is a third of all rows is as many
window partitions as it needs. Apportioning k parts contests about 4 k seats (see `apportioned`), whatever the number of
seats; no block is ever made into a row.

Defined cases: a null text has size 0; a null source is a source, after all others; an empty table gives an empty result;
a source without words has target 0. Rows that repeat an identifier, in one source or in several, are documents of their
own, each with its own share: rows are told apart by a digest of all their columns (of map type: all but those), and only
rows equal in every column are interchangeable. Other columns, whatever their names, are carried untouched by `mixture`.
The number of sources is taken to be small (a row each is sorted in one task), the number of rows is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm._common import word_count, written

#: Source rows are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000
SPANS = "array<struct<a:bigint,b:bigint>>"


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most_passes: int) -> DataFrame:
    """totals: source, source_size. Adds nth (from 1) and target, by filling in order of capacity for each weight."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("nth", F.row_number().over(one))
    turn = F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
    t = t.withColumn("capacity", (F.col("source_size") * most_passes).cast("double"))
    by_ratio = Window.orderBy(F.col("capacity") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    mix = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    given = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    t = t.withColumn("level", (mix - given) / F.sum("weight").over(rest))
    # In this order, once a source stays below its capacity all later ones do, at the same level.
    below = F.when(F.col("capacity") > F.col("level") * F.col("weight"), F.col("level"))
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", F.first(below, ignorenulls=True).over(all_rows))
    due = F.coalesce(F.col("level") * F.col("weight"), F.col("capacity"))
    return t.withColumn("target", F.least("capacity", due)).select("source", "source_size", "nth", "target")


def apportioned(parts: DataFrame, part: str, votes: str, seats: Column, groups: list[str], out: str) -> DataFrame:
    """Adds the seats of each part by Sainte-Laguë, in each group by itself. seats: a group's seats, the same in all its rows.

    With V votes, S seats and k parts the divisor of the method lies between V / (S + k/2) and V / (S - k/2). So a part's
    seats below the first bound are certain and those above the second are out of reach, and the seats between them, which
    are contested by their quotients, are about 4 k in a group, not k for each part.
    """
    whole = Window.partitionBy(*groups)
    t = parts.withColumn("_seats", seats.cast("long"))
    half, total = F.count(F.lit(1)).over(whole) / 2, F.sum(votes).over(whole)
    reach = lambda more: F.coalesce(F.try_divide(F.col(votes) * F.greatest(F.lit(0.0), F.col("_seats") + more), total), F.lit(0.0))
    # One seat of room on either side for rounding.
    t = t.withColumn("_sure", F.greatest(F.lit(0), F.floor(reach(-half) + 0.5) - 1).cast("long"))
    t = t.withColumn("_most", F.floor(reach(half) + 0.5).cast("long") + 1)
    t = t.withColumn("_left", F.col("_seats") - F.sum("_sure").over(whole))
    tried = t.where(f"{votes} > 0 and _most > _sure")
    tried = tried.select(*groups, part, votes, "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_s"))
    order = Window.partitionBy(*groups).orderBy((F.col(votes) / (2 * F.col("_s") + 1)).desc(), part, "_s")
    won = tried.withColumn("_rank", F.row_number().over(order)).where("_rank <= _left")
    won = won.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_won"))
    got = t.join(won, [*groups, part], "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return got.drop("_seats", "_sure", "_most", "_left", "_won")


def _row_key(docs: DataFrame) -> Column:
    """A digest of all columns that have one, equal for equal rows."""
    return F.xxhash64(*[docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def _placed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most_passes: int, least_shards: int, shard_words: int,
    blocks: int, source_blocks: int, seed: int,
) -> DataFrame:
    """`mixed` with the key of each row."""
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), _row_key(docs).alias("key"))
    sized = written(sized.withColumn("place", F.xxhash64("id", F.lit(seed))), "mix-sizes")
    totals = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_passes)
    everything = Window.partitionBy()
    mix, least = F.sum("target").over(everything), F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.floor(F.least(mix / blocks, least / source_blocks)))
    totals = totals.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
    totals = apportioned(totals, "nth", "target", F.round(F.sum("target").over(everything) / F.col("block")), [], "source_blocks")
    quota = F.least(F.col("source_blocks") * F.col("block"), F.col("source_size") * most_passes)
    shards = F.greatest(F.lit(least_shards), F.ceil(F.col("source_size") / shard_words)).cast("int")
    totals = totals.select("source", "source_size", "nth", "target", quota.alias("words"), shards.alias("shards"))
    totals = written(totals, "mix-sources")
    side = F.broadcast(totals) if totals.count() <= BROADCAST_SOURCES else totals
    dealt = sized.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    dealt = dealt.select("id", "d.source", "size", "key", "place", "nth", F.pmod(F.xxhash64("place"), F.col("shards")).cast("int").alias("shard"))
    cells = dealt.groupBy("nth", "shard").agg(F.sum("size").cast("long").alias("n"))
    known = totals.select("nth", "source_size", "target", "words")
    cells = cells.join(F.broadcast(known) if side is not totals else known, "nth").withColumn("votes", F.col("n").cast("double"))
    cells = apportioned(cells, "shard", "votes", F.col("words"), ["nth"], "quota")
    cells = cells.withColumn("quota", F.least(F.col("quota"), F.col("n") * most_passes))
    cells = cells.withColumn("passes", F.coalesce(F.try_divide(F.col("quota"), F.col("n")).cast("long"), F.lit(0)))
    cells = cells.withColumn("over", F.col("quota") - F.col("passes") * F.col("n"))
    start = F.when(F.col("over") > 0, F.pmod(F.xxhash64(F.col("nth"), F.col("shard"), F.lit(seed)), F.col("n"))).otherwise(0)
    cells = cells.withColumn("lo", start).withColumn("hi", start + F.col("over"))
    cells = cells.withColumn("hi_wrapped", F.greatest(F.lit(0), F.col("hi") - F.col("n")))
    cells = cells.select("nth", "shard", "source_size", "target", "passes", "lo", F.least("hi", "n").alias("hi"), "hi_wrapped")
    stream = Window.partitionBy("nth", "shard").orderBy("place", "id", "key")
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    both = placed.join(written(cells, "mix-quotas"), ["nth", "shard"]).withColumn("at", F.col("end") - F.col("size"))
    inside = lambda a, b: F.greatest(F.lit(0), F.least("end", b) - F.greatest("at", a))
    both = both.withColumn("main", inside("lo", "hi")).withColumn("wrapped", inside(F.lit(0), "hi_wrapped"))
    both = both.withColumn("taken", F.col("size") * F.col("passes") + F.col("main") + F.col("wrapped"))
    part_from = F.when(F.col("main") > 0, F.greatest(F.lit(0), F.col("lo") - F.col("at"))).otherwise(0)
    part_to = F.when(F.col("wrapped") > 0, F.col("wrapped")).when(F.col("main") > 0, F.col("hi") - F.col("at")).otherwise(0)
    both = both.withColumn("part_from", part_from).withColumn("part_to", F.least(F.col("size"), part_to))
    both = both.withColumn("split", (F.col("main") > 0) & (F.col("wrapped") > 0))
    return both.select("id", "source", "key", "size", "source_size", "target", "taken", "passes", "part_from", "part_to", "split")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, most_passes: int = 2, shards: int = 256, shard_words: int = 1 << 22, blocks: int = 1_000_000, source_blocks: int = 100, seed: int = 7,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken; and passes (whole times it is taken) with the
    words [part_from, part_to) that a further pass takes. taken = size * passes + the words of that part; where the leftover
    run wraps round inside one document its two ends are taken: [0, part_to) and [part_from, size)."""
    rows = _placed(docs, id_col, text_col, source_col, weights, share, most_passes, shards, shard_words, blocks, source_blocks, seed)
    return rows.drop("key").withColumnsRenamed({"id": id_col, "source": source_col})


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, most_passes: int = 2, shards: int = 256, shard_words: int = 1 << 22, blocks: int = 1_000_000, source_blocks: int = 100, seed: int = 7,
) -> DataFrame:
    """The mix itself: the rows of docs as many times as they are taken, the last time perhaps only some of their words.

    A part keeps the white space before its words; n_chars, where there is such a column, follows.
    """
    picked = _placed(docs, id_col, text_col, source_col, weights, share, most_passes, shards, shard_words, blocks, source_blocks, seed)
    picked = written(picked.where("taken > 0").select("id", "key", "size", "passes", "part_from", "part_to", "split"), "mix-picks")
    picked = picked.select(*[F.col(c).alias(f"_mix_{c}") for c in picked.columns])
    whole_row = F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row")
    rows = docs.select(whole_row, docs[id_col].alias("_mix_doc"), docs[text_col].alias("_mix_text"), _row_key(docs).alias("_mix_own"))
    same = F.col("_mix_doc").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_own") == F.col("_mix_key"))
    if not picked.groupBy("_mix_id", "_mix_key").count().where("count > 1").isEmpty():
        # Rows equal in every column: each takes one of the shares that fell to them.
        copy = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[-1]))
        share_no = F.row_number().over(Window.partitionBy("_mix_id", "_mix_key").orderBy("_mix_passes", "_mix_part_from", "_mix_part_to"))
        picked, rows = picked.withColumn("_mix_nth", share_no), rows.withColumn("_mix_copy", copy("_mix_doc", "_mix_own"))
        same = same & (F.col("_mix_nth") == F.col("_mix_copy"))
    rows = rows.join(picked, same)
    size, a, b = F.col("_mix_size"), F.col("_mix_part_from"), F.col("_mix_part_to")
    none, span = F.array().cast(SPANS), lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    part = F.when(F.col("_mix_split"), F.array(span(F.lit(0), b), span(a, size))).when(b > a, F.array(span(a, b))).otherwise(none)
    whole = F.when(F.col("_mix_passes") > 0, F.array_repeat(span(F.lit(0), size), F.col("_mix_passes").cast("int"))).otherwise(none)
    rows = rows.withColumn("_mix_span", F.explode(F.concat(whole, part)))
    from_, to = F.col("_mix_span.a").cast("int"), F.col("_mix_span.b").cast("int")
    words = F.regexp_extract_all("_mix_text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when((from_ == 0) & (to == size), F.col("_mix_text")).otherwise(F.array_join(F.slice(words, from_ + 1, to - from_), ""))
    rows = rows.withColumn("_mix_cut", cut)
    new = {text_col: F.col("_mix_cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_mix_cut").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("_mix_row").getField(c)).alias(c) for c in docs.columns])
