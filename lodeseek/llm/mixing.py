"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence fall on the sources' cumulative targets, so every prefix of the schedule holds the
sources near their shares. A slot's rank within its source names a block of equally many words of that source's
shuffled, repeated stream of documents; slots and documents meet in a join on (source, block).

Ranks and word positions are running sums over ranges of one order, and over the ranges before, so no source and no id
is gathered in one task. Sources are a table like any other, of any length: their numbers, targets and cumulative shares
are running sums, too, slots find their source by a sorted sweep, and only single numbers pass through the driver.

Defined results: a null text has size 0; documents of size 0 are never taken; very long texts are cut by the blocks
like others; rows that are the same in id and size stand in one order, that of their row numbers; null is a source of its own, the last;
repeated rows each count; with no words at all every target and take is 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, running, written
from .feistel_shards import numbered
from .url_rules import swept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE_OF_SIZES = 1.5
MOST_REPEATS = 2.0
#: Words in a block, about: each source's blocks are cut a little smaller or larger, so that they fill its target.
BLOCK = 1024
GOLDEN = (math.sqrt(5) - 1) / 2


def with_targets(sources: DataFrame, share: float = SHARE_OF_SIZES, most: float = MOST_REPEATS) -> DataFrame:
    """sources(source_no, source_size, ...) with their target: shares of all words by weight, none over most times its size; what goes beyond is shared again by weight.

    A target is the lesser of its cap and its weight times one unit, at which they make up the total. In the order of
    cap by weight the capped sources come first; after k of them the unit is the rest by the rest's weights, which
    grows as long as the next one is capped and not after, so the largest is the one."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    rows = sources.withColumn("weight", F.get(weights, (F.col("source_no") % len(WEIGHTS)).cast("int"))).withColumn("cap", F.col("source_size") * most)
    words, weight = rows.where("source_size > 0").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    total = min(share, most) * words
    ranked = running(rows.where("source_size > 0").select("source_no", (F.col("cap") / F.col("weight")).alias("ratio"), "cap", "weight"), ["ratio", "source_no"], {"caps": "cap", "weights": "weight"})
    rest = F.lit(float(weight)) - (F.col("weights") - F.col("weight"))
    unit = ranked.agg(F.max((F.lit(float(total)) - (F.col("caps") - F.col("cap"))) / rest)).first()[0] or 0.0
    return rows.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(float(unit)))).drop("cap", "weight")


def _key(source: Column) -> Column:
    """Sources by a key that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def schedule(shares: DataFrame, total: int, slots: int) -> DataFrame:
    """slot and source_no, and rank of the slot within its source, for shares(source_no, words, above): words is a source's share of total, above that of the sources before it."""
    point = (F.col("id") * F.lit(GOLDEN)) % F.lit(1.0)
    drawn = shares.sparkSession.range(1, slots + 1).select((F.col("id") - 1).alias("uid"), (F.col("id") - 1).alias("slot"), point.alias("key"))
    ends = shares.where("words > 0").select((F.col("above") / F.lit(float(total))).alias("key"), F.struct("source_no").alias("state"))
    placed = numbered(swept(drawn, ends, ["key"]).select(F.col("state.source_no").alias("source_no"), "slot"), ["source_no", "slot"])
    first = placed.groupBy("source_no").agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n"))
    return looked_up(placed, first, ["source_no"], slots).select("slot", "source_no", (F.col("row_no") - F.col("first")).alias("rank"))


def positions(docs: DataFrame, seed: int = 0, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Every row of docs(doc_id, text, source, *carried) with its size, its place in its source's shuffled stream and a row id; and the sources."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", _key(F.col("source")).alias("source_key"), *carried, words.alias("size"))
    sized = written(sized.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    per = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumn("none", F.col("source_key") == "")
    named = with_targets(numbered(per, ["none", "source_key"], "source_no"))
    # words of all sources before each
    sources = written(running(named, ["source_no"], {"until": "source_size"}).withColumn("before", F.col("until") - F.col("source_size")).drop("until", "none"), "sources")
    rows = looked_up(sized, sources.select("source_key", "n", "source_no", "source_size", "target", "before"), ["source_key"], sized.count())
    ordered = running(rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), ["source_no", "h", "doc_id", "size", "uid"], {"until": "size"})
    placed = ordered.withColumn("start", F.col("until") - F.col("size") - F.col("before")).drop("until", "before", "h", "source_key")
    return placed, sources.drop("source_key")


def mixture(docs: DataFrame, seed: int = 0, block: int = BLOCK, *carried: str) -> tuple[DataFrame, DataFrame]:
    """The mix: slot, doc_id, uid and the words [from_word, to_word) that the slot takes of the document; and the rows as positions() gives them."""
    placed, sources = positions(docs, seed, *carried)
    placed = written(placed, "positions")
    shares = written(running(sources.select("source_no", "n", F.floor(F.col("target") + 1e-6).alias("words")), ["source_no"], {"until": "words"}).withColumn("above", F.col("until") - F.col("words")), "shares")
    total, rows_in_all = shares.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    slots = max(1, -(-total // block))
    if total:
        drawn = written(schedule(shares, total, slots), "schedule")
    else:
        drawn = docs.sparkSession.createDataFrame([], "slot long, source_no long, rank long")
    got = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("slots"))
    plan = written(shares.where("words > 0").join(got, "source_no", "left").select("source_no", "n", "words", F.coalesce("slots", F.lit(1)).alias("slots"), F.col("slots").isNull().alias("missed")), "plan")
    # a source whose share is under a slot's width may be missed: it gets one slot behind the others
    extra = numbered(plan.where("missed").select("source_no"), ["source_no"]).select((F.col("row_no") + slots).alias("slot"), "source_no", F.lit(0).cast("long").alias("rank"))
    drawn = drawn.unionByName(extra)
    rows = looked_up(placed.where("size > 0"), plan.drop("missed"), ["source_no"], rows_in_all)
    epochs = F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size"))
    passes = rows.withColumn("epoch", F.explode(F.when(F.col("start") < F.col("words"), F.sequence(F.lit(0).cast("long"), epochs)).otherwise(F.array().cast("array<long>"))))
    passes = passes.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least("words", F.col("lo") + F.col("size")))
    # block r holds the words from ceil(r * words / slots) on; the block of word x is floor(x * slots / words)
    exact = lambda x: F.floor(x.cast("decimal(38,0)") * F.col("slots") / F.col("words")).cast("long")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), exact(F.col("lo")) - 1), F.least(F.col("slots") - 1, exact(F.col("hi") - 1) + 1))))
    first = F.ceil(F.col("rank").cast("decimal(38,0)") * F.col("words") / F.col("slots")).cast("long")
    last = F.ceil((F.col("rank") + 1).cast("decimal(38,0)") * F.col("words") / F.col("slots")).cast("long")
    pieces = pieces.withColumn("a", F.greatest("lo", first)).withColumn("b", F.least("hi", last)).where("a < b")
    mix = pieces.join(drawn, ["source_no", "rank"]).select("slot", "doc_id", "uid", (F.col("a") - F.col("lo")).alias("from_word"), (F.col("b") - F.col("lo")).alias("to_word"))
    return mix, placed


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    mix, placed = mixture(docs, seed)
    sums = mix.groupBy("uid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return placed.join(sums, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
