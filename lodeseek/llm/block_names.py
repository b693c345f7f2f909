"""Exact duplicates by names of blocks, in DataFrame operations only.

A normalised text is cut into blocks of BLOCK bytes. Distinct blocks are sorted, by hash and then by their bytes, and
their places in that order are their names. Then the names of adjacent blocks are paired (an odd last one with none),
distinct pairs are sorted and numbered in turn, and so on, until each text has one name. Two texts of as many rounds
have the same name if and only if they are equal: no step rests on a hash alone, as blocks that share one are told
apart by their bytes.

What travels: each distinct block once (copies meet on the map side, in sets by hash), then rows of a few numbers,
half as many with each round. A name goes back to its rows by a join. Keys that hold more than 1 in HOT of the rows,
so HOT at most, whatever the data, are broadcast instead, and none of the other keys is large.

Defined results: a null text is an empty one, and all empty ones are equal; of rows with the same least id one stays;
null ids come last (a group without any id has a null keep_id); an empty table gives an empty result; other columns
are ignored; a text of any length is one row of 8 bytes for each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, Scratch, looked_up, written
from .feistel_shards import numbered

BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def blocks_of(raw: Column, block: int) -> Column:
    """The bytes in blocks; one empty block for no bytes."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / block)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * block + 1, F.lit(block)))


def _block_names(cut: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Names of distinct blocks by (h, nth), and the blocks (h, nth, block) of hashes that several blocks share."""
    found = cut.groupBy("h").agg(F.collect_set("block").alias("blocks"), F.count(F.lit(1)).alias("n"))
    one = F.size("blocks") == 1
    sets = scratch.written(found.select("h", "n", F.when(~one, F.array_sort("blocks")).alias("blocks")), "blocks")
    nth = sets.select("h", "n", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("blocks") - 1))).alias("nth"))
    shared = sets.where(F.col("blocks").isNotNull()).select("h", F.posexplode("blocks").alias("nth", "block"))
    return numbered(nth, ["h", "nth"], "name", scratch), shared


def duplicates(docs: DataFrame, block: int = BLOCK, hashed=F.xxhash64, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        raw = docs.select("doc_id", F.encode(normalised(F.col("text")), "UTF-8").alias("raw"))
        parts = raw.select("doc_id", F.sha2("raw", 256).alias("text_sha256"), blocks_of(F.col("raw"), block).alias("blocks"))
        names, shared = _block_names(parts.select(F.explode("blocks").alias("block")).select("block", hashed(F.col("block")).alias("h")), scratch)
        numbered_parts = parts.withColumn("uid", F.monotonically_increasing_id())
        if shared.isEmpty():
            texts = scratch.written(numbered_parts.select("uid", "doc_id", "text_sha256", F.transform("blocks", lambda b: hashed(b)).alias("hashes")), "texts")
            places = texts.select("uid", F.size("hashes").alias("of"), F.posexplode("hashes").alias("at", "h")).withColumn("nth", F.lit(0))
        else:
            # hashes alone do not tell these blocks apart: they are looked up by their bytes, too
            cut = numbered_parts.select("uid", "doc_id", "text_sha256", F.size("blocks").alias("of"), F.posexplode("blocks").alias("at", "block"))
            told = cut.withColumn("h", hashed(F.col("block"))).join(shared, ["h", "block"], "left").drop("block").na.fill(0, ["nth"])
            told = scratch.written(told, "texts")
            texts, places = told.where("at = 0").select("uid", "doc_id", "text_sha256"), told.select("uid", "of", "at", "h", "nth")
        sums = places.agg(F.count(F.lit(1)), F.max("of")).first()
        total, longest = sums[0], sums[1] or 0
        rows = looked_up(places, names, ["h", "nth"], total, hot).drop("h", "nth")
        level, ended = 0, []
        while True:
            half = F.floor(F.col("at") / 2).cast("int")
            side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
            pairs = scratch.written(rows.groupBy("uid", "of", half.alias("at")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b")), "pairs")
            ended.append(pairs.where("of = 1").select("uid", F.lit(level).alias("rounds"), F.col("a").alias("name")))
            if longest <= 1:
                break
            pairs = pairs.where("of > 1").withColumn("of", F.ceil(F.col("of") / 2).cast("int"))
            seen = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
            rows = looked_up(pairs, numbered(seen, ["a", "b"], "name", scratch), ["a", "b"], total, hot)
            level, longest = level + 1, -(-longest // 2)
        identity = ended[0]
        for e in ended[1:]:
            identity = identity.unionByName(e)
        known = scratch.written(texts.drop("hashes").join(identity, "uid"), "identities")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
        groups = scratch.written(known.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("n"), first), "groups")
        groups = groups.select("rounds", "name", "n", F.col("n").alias("group_size"), F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"))
        out = looked_up(known, groups, ["rounds", "name"], known.count(), hot)
        return written(out.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256"), "exact")
