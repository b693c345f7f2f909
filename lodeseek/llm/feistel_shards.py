"""Shards by a Feistel permutation over global row numbers, in DataFrame operations only.

Rows are numbered in the order of (doc_id, checksum, size). A permutation of the numbers 0 to n - 1 shuffles them:
place p goes to shard p mod k, slot p div k, so shards hold counts at most one apart and slots have no gap, and both
can be computed from a row number alone. The permutation is a Feistel network on a grid of a by b cells with
a = ceil(sqrt(n)) and b = ceil(n / a); a number that lands beyond n walks on along its cycle. Fewer than a cells lie
beyond n, so WALK steps are enough for certain up to WALK ** 2 rows, and beyond that but for odds of n ** (-WALK / 2); a
number that is not back by then is an error, never a wrong slot.

Defined results: a null text has size 1 and the checksum of no bytes; null ids come first; rows that are the same in
id, checksum and size are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, written

ROUNDS = 6
WALK = 64
#: The round function's modulus (a Mersenne prime, so squares stay below 2 ** 62) and round keys.
MODULUS = 2147483647
KEYS = (1204873, 998244353, 715827883, 1610612741, 402653189, 805306457, 50331653, 201326611)


def numbered(rows: DataFrame, order: list[str], name: str = "row_no", within: Scratch | None = None) -> DataFrame:
    """Global row numbers from 0 in the given order: a range-partitioned sort, then the count of rows in earlier partitions.

    The sorted rows are written once, so the two reads of them agree. Only one row for each partition is counted on."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    kept = written(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")), "numbered", within)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # one row for each of n partitions
    return kept.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, rounds: int = ROUNDS, walk: int = WALK) -> Column:
    """The place of a row number, 0 <= number < n, under the permutation."""
    a, b = grid(n)
    keys = F.array(*[F.lit(KEYS[i % len(KEYS)] + i) for i in range(rounds)])

    def mixed(half: Column, key: Column) -> Column:
        x = (half + key) % MODULUS
        return (x * x + key) % MODULUS

    def once(p: Column) -> Column:
        # halves change places each round, and so do their ranges; an even number of rounds ends as it began
        start = F.struct(((p - p % b) / b).cast("long").alias("x"), (p % b).cast("long").alias("y"), F.lit(0).alias("i"))
        step = lambda s, key: F.struct(
            F.when(s["i"] % 2 == 0, (s["x"] + mixed(s["y"], key)) % a).otherwise(s["x"]).cast("long").alias("x"),
            F.when(s["i"] % 2 == 1, (s["y"] + mixed(s["x"], key)) % b).otherwise(s["y"]).cast("long").alias("y"),
            (s["i"] + 1).alias("i"),
        )
        return F.aggregate(keys, start, step, lambda s: s["x"] * F.lit(b) + s["y"])

    first = once(number.cast("long"))
    steps = F.sequence(F.lit(1), F.lit(max(1, min(walk, a * b - n))))
    place = F.aggregate(steps, first, lambda p, _: F.when(p < n, p).otherwise(once(p)))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("a row number has not come back below the number of rows; take a longer walk")))


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs(doc_id, text)."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = numbered(rows, ["doc_id", "text_crc32", "size"])
    n = placed.count()
    place = permuted(F.col("row_no"), n)
    return placed.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
