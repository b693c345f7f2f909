"""MinHash-style near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles. Register i holds the exponentially spaced, truncated minimum of an
exponential variable over the set, so registers of a union are maxima of registers, and two sets agree in a register
with about their Jaccard similarity. Bands of register values propose pairs; a joint likelihood over which of two
registers is the larger drops hopeless ones; the rest is verified on the full sets. Links become components.

Copies meet first: documents of one word sequence form a class, which has one sketch. Only small buckets are paired
within. A larger bucket's members are set against one leader; who is linked to it joins its component. Only members of
different components need further tests, so buckets end that lie in one component, as those of many near copies do
after a turn or two.

What is still open is a crowd of texts that are alike but, for the most part, not alike enough. It is dealt out exactly,
by what sets its members apart from their leader L. Let D(x) be the shingles that only one of x and L has, m(x) how many
of them are L's. Then |x & y| = |L| - m(x) - m(y) + |D(x) & D(y)|, so x and y are linked where |D(x) & D(y)| reaches
f(x) + f(y) - |L|, with f(x) = m(x) + share * |x|. Where that is 0 or less, x is linked to the member of least f as well,
so one turn against that member joins them. All other links share shingles of D, in which most of a crowd's members have
little in common: shingles that only one component has in its D are dropped, the rest are ordered by how many members have them, and
two members meet if they share one of the first d - needed + 1 shingles of either, within classes of like f. Buckets of these shingles
take turns as before, and the few that are open at last are tested pair by pair. No candidate is dropped.

Both the leader's turn and the dealing salt a bucket by its members, so that none gathers in one task.

Defined results: a null text, or one without words, has an empty set and no link; texts with fewer words than a
shingle are one shingle; repeated rows each get their row, with the component of their class; a null doc_id
represents no component that has another; ties in similarity all link; a very long text is taken whole, its set and sketch
made in pieces of bounded size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, Scratch, gram_hashes, slices, span_hashes, splitmix, text_buffer, word_spans
from .common import written as written_by_all

WORDS = 5
#: Pairs are linked from this similarity on, as a share of hundredths, unless the caller names another.
LINK = 85
#: A pair at the threshold is missed in all bands with odds of so much at most, within about so many registers.
MISSED, MOST_REGISTERS = 2e-6, 170
#: Base of the registers' spacing, rate of the exponential variables, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_534


class Shape(NamedTuple):
    """Bands of rows registers each for pairs at link hundredths; pairs whose likeliest similarity is under hopeless are not verified."""

    link: int
    bands: int
    rows: int
    hopeless: float

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shape_for(link: int) -> Shape:
    """The longest bands that miss a pair at the threshold with odds of MISSED at most: 28 of 6 at 85, 34 of 5 at 80.

    With so many registers the likeliest similarity of a pair at the threshold has a standard error of about 0.03, so what is
    hopeless lies six errors and more below it: such a pair is misjudged with odds under one in a million."""
    rows, shape = 1, None
    while True:
        at_one = (link / 100) ** rows
        bands = 1 if at_one == 1 else math.ceil(math.log(MISSED) / math.log1p(-at_one))
        if shape and (bands * rows > MOST_REGISTERS or bands == 1):
            return shape
        rows, shape = rows + 1, Shape(link, bands, rows, max(0, link - 20) / 100)


_SHAPE = shape_for(LINK)
REGISTERS = _SHAPE.registers
#: Buckets of up to so many classes are paired within; in larger ones all are set against a leader, in TURNS turns at most.
SMALL, TURNS = 6, 3
#: Turns in the buckets of first shingles at most, before what is open there is paired.
LAST_TURNS = 2
#: A turn that links less than one in so many of the pairs it tests is the last: another would take all members again for as few links. What is left open is dealt out or paired, so no pair is lost.
WORTH = 16
#: Members of a crowd are dealt by classes of f; a class is this share of the leader's shingles wide.
CLASS_SHARE = 1 / 32
#: Parts of a bucket in joins, at most in turns, and members of a part in the last pairing.
SALTS, PART = 16, 256


#: A task that writes takes so many partitions of a shuffle, where there are many: to start a writer costs more than most of these tables' partitions do.
PARTS_WRITTEN = 8


def written(df: DataFrame, name: str, within: Scratch | None = None) -> DataFrame:
    """df, which comes from a shuffle, as a table: shuffled and joined in all partitions, written by fewer tasks, four for each core at least."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTS_WRITTEN)
    return written_by_all(df.coalesce(tasks), name, within)


def _factors(registers: int) -> np.ndarray:
    return splitmix(np.arange(1, registers + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)



def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and a hash of each row's word sequence."""
    data = LOWER[data]
    s, e, first = word_spans(data, offsets, SPACE)
    w = span_hashes(data, s, e)
    g = gram_hashes(w, k)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            sets.append(splitmix(gram_hashes(w[a:b], b - a) + U64(b - a)))
        else:
            sets.append(np.empty(0, U64))
    n = np.diff(first)
    place = np.arange(len(w), dtype=U64) - np.repeat(first[:-1], n).astype(U64)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(splitmix(w ^ splitmix(place * U64(0x9E3779B97F4A7C15) + U64(1))), dtype=U64)))
    return sets, splitmix(sums[first[1:]] - sums[first[:-1]] + n.astype(U64))


def minima(elements: np.ndarray, step: int = 2048, registers: int = REGISTERS) -> np.ndarray:
    low = np.full(registers, 0xFFFFFFFFFFFFFFFF, U64)
    x, factors = splitmix(elements), _factors(registers)
    for i in range(0, len(x), step):
        np.minimum(low, (x[i : i + step, None] * factors).min(0), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """Register values of minima of uniform hashes: 0 where the set is empty."""
    u = (low.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, shape: Shape = _SHAPE) -> np.ndarray:
    """A 64-bit key for each band of each row of registers; bands have keys of their own."""
    h = np.broadcast_to(np.arange(1, shape.bands + 1, dtype=U64), (len(regs), shape.bands))
    v = regs.reshape(len(regs), shape.bands, shape.rows).astype(U64)
    for j in range(shape.rows):
        h = splitmix(h * U64(0x9E3779B97F4A7C15) + v[:, :, j] + U64(1))
    return h


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 40) -> np.ndarray:
    """The similarity under which the registers of each pair of sets, of known sizes, are likeliest."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def larger(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = larger(u - v * j), larger(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(steps):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = log_likelihood(x) > log_likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


SKETCH = "n_shingles long, node long, regs binary"


def _sketched(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 2 << 20):
        sets, digests = shingles(*text_buffer(part.column(part.schema.get_field_index("text"))))
        done: dict[int, bytes] = {}  # equal sequences in a slice are sketched once
        regs = []
        for s, d in zip(sets, digests.tolist(), strict=True):
            if d not in done:
                done[d] = registers(minima(s, registers=shape.registers)).tobytes() if len(s) else b""
            regs.append(done[d])
        yield pa.RecordBatch.from_pydict({
            **{name: part.column(i) for i, name in enumerate(part.schema.names) if name != "text"}, "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "node": pa.array(digests.view(np.int64)), "regs": pa.array(regs, pa.binary()),
        })


def _banded(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, shape.registers)
            flat = band_keys(regs, shape).view(np.int64).reshape(-1)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * shape.bands), pa.array(flat))
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "size": batch.column(2), "keys": keys})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        sets, digests = shingles(*text_buffer(part.column(0)))
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"node": pa.array(digests.view(np.int64)), "items": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))})


#: Bits of a bitmap for each of its keys, and the most that any has, as a power of two: 8 MB.
KEY_BITS, MOST_BITS = 64, 26
#: Tasks that bring a bitmap's words to the driver.
WORD_TASKS = 8


def _among(keys: DataFrame) -> Callable[[str], Column]:
    """A test of a long column that holds wherever it is among the keys(key), and seldom elsewhere: it spares joins the shuffle of rows without a partner.

    Its bitmap has a bounded size; with very many keys more rows pass in vain, which the join behind it drops."""
    n = keys.count()
    bits = min(max(16, (KEY_BITS * n).bit_length()), MOST_BITS)
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(7)), F.lit(1 << bits))
    at = keys.select(place("key").alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    # a million words at most, whatever the keys: a few tasks bring them
    words = at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("held")).coalesce(WORD_TASKS).toArrow()
    table = np.zeros((1 << bits) // 64, np.int64)
    table[words["word"].to_numpy()] = words["held"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table.view(U64))

    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy(U64)
        return pd.Series((shared.value[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1)

    return lambda c: F.pandas_udf(held, "boolean")(place(c))


def _likeliest(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    of = lambda s: np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1)
    return pd.Series(likeliest(of(a), of(b), na.to_numpy(float), nb.to_numpy(float))) if len(a) else pd.Series([], dtype=float)


def similarities(pairs: DataFrame, classes: DataFrame, sets: DataFrame, hopeless: float = _SHAPE.hopeless) -> DataFrame:
    """pairs(a, b) whose registers are not hopeless, with their sizes and the size of their intersection."""
    judged = F.pandas_udf(_likeliest, "double")
    paired = _among(pairs.select(F.explode(F.array("a", "b")).alias("key")))
    c, sets = classes.select("node", "n_shingles", "regs").where(paired("node")), sets.where(paired("node"))
    x = pairs.join(c.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra")), "a")
    x = x.join(c.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb")), "b")
    x = x.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(hopeless * 100))
    x = x.where(judged("ra", "rb", "na", "nb") >= hopeless).select("a", "b", "na", "nb")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("items").alias("sb")), "b")
    return x.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))


def _buckets(members: DataFrame) -> DataFrame:
    """The members(bucket, node, size) of buckets with company; buckets of equal members count once."""
    whole = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1")
    one = whole.groupBy("n", "lead", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return members.join(one, "bucket")


#: Of a bucket's members: what a bucket is dealt by is the shingle at place at of d; two members need (g + g) / (200 + 2 * link) shingles in common.
MEMBER = ("node", "size", "company", "at", "d", "g")


def _salt(salts: int | Column = SALTS) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(5)), salts if isinstance(salts, Column) else F.lit(salts)).cast("int")


def _with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members with the component of each node in comp: itself, as long as it is not linked."""
    if found is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(found, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("comp"))


def _open(held: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """Members of the buckets that lie in more than one component, with their own, the bucket's size, its leader in this turn, and in origin the one of turn 0.

    A bucket is kept or left as a whole, so its size n stays. Each member makes one row."""
    here = _with_components(held.select("bucket", "n", *MEMBER), found)
    # one order of all nodes in each turn, so that a node leads in most of its buckets: first by company, as the original of
    # many copies is nearer to each of them than they are to each other, then at random
    order = F.col("company") if turn % 2 == 0 else F.lit(0).cast("long")
    first = F.max(F.struct(order.alias("by"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp", "size"))
    origin = F.max(F.struct(F.col("company").alias("by"), F.xxhash64("node", F.lit(0)).alias("h"), "node"))
    per = here.groupBy("bucket", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), first.alias("lead"), origin.alias("origin")).where("lo <> hi")
    salts = F.least(F.lit(SALTS), 1 + F.floor(F.col("n") / SALTS)).cast("int")
    told = per.select("bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "lead", "origin")
    return here.withColumn("salt", _salt(salts)).join(told, ["bucket", "salt"]).drop("salt")


def _pairs_within(few: DataFrame, found: DataFrame | None, link: int) -> DataFrame:
    """Pairs of different components in buckets of a few members each, that their sizes and places allow."""
    members = _with_components(few.select("bucket", "node", "size", "at", "d", "g"), found)
    lists = members.groupBy("bucket").agg(F.collect_list(F.struct("node", "comp", "size", "at", "d", "g")).alias("m"))
    room = f"(200 + 2 * {link}) * LEAST(x.d - x.at, y.d - y.at) >= x.g + y.g AND 100 * LEAST(x.size, y.size) >= {link} * GREATEST(x.size, y.size)"
    met = f"FLATTEN(TRANSFORM(m, x -> TRANSFORM(FILTER(m, y -> x.node < y.node AND x.comp <> y.comp AND {room}), y -> NAMED_STRUCT('a', x.node, 'b', y.node))))"
    return lists.select(F.explode(F.expr(met)).alias("p")).select("p.a", "p.b")


def _all_pairs(here: DataFrame, link: int) -> DataFrame:
    """Pairs of a bucket's members in different components that their sizes and places allow, in parts of a bucket.

    Only members outside of the bucket's main component are set against all, as pairs within one component need no test."""
    sums = here.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("main"))
    salted = here.withColumn("salt", _salt())
    mains = salted.select("bucket", "salt").distinct().join(sums.select("bucket", F.col("main.comp").alias("main")), "bucket")
    side = lambda c: [F.col(k).alias(f"{k}_{c}") for k in ("node", "comp", "size", "at", "d", "g")]
    part = (1 + F.floor(F.col("n") / PART)).cast("int")
    few = salted.join(mains, ["bucket", "salt"]).where("comp <> main").select("bucket", "main", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"), *side("a"))
    all_ = here.select("bucket", F.pmod(F.xxhash64("node", F.lit(9)), part).cast("int").alias("part"), *side("b"))
    # a shingle at some place leaves so many for what two members have in common, if they share none before it
    room = f"(200 + 2 * {link}) * LEAST(d_a - at_a, d_b - at_b) >= g_a + g_b"
    pairs = few.join(all_, ["bucket", "part"]).where(f"comp_a <> comp_b AND (comp_b = main OR node_a < node_b) AND {room} AND 100 * LEAST(size_a, size_b) >= {link} * GREATEST(size_a, size_b)")
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _stars(here: DataFrame, link: int) -> DataFrame:
    """Pairs of a bucket's leader and its members in other components, as far as their sizes allow."""
    apart = here.where(f"comp <> lead.comp AND 100 * LEAST(size, lead.size) >= {link} * GREATEST(size, lead.size)")
    return apart.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))


def _beside_leaders(here: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """lead, node, size, company, comp, salt, n_head, g and the difference of every member of a crowd and its leader.

    g = (200 + 2 * link) * (f - |L| / 2), a whole number."""
    crowd = here.select(F.col("lead.node").alias("lead"), "node", "size", "company", "comp").distinct().withColumn("salt", _salt(64))
    sets = sets.where(_among(here.select(F.explode(F.array("node", "lead.node")).alias("key")))("node"))
    heads = crowd.select("lead", "salt").distinct().join(sets.select(F.col("node").alias("lead"), F.col("items").alias("head")), "lead")
    each = crowd.join(sets, "node").join(heads, ["lead", "salt"]).withColumn("missing", F.array_except("head", "items"))
    g = 2 * ((100 + link) * F.size("missing") + link * F.col("size")) - (100 + link) * F.size("head")
    return each.select("lead", "node", "size", "company", "comp", "salt", F.size("head").alias("n_head"), g.cast("long").alias("g"), F.concat(F.array_except("items", "head"), "missing").alias("diff"))


def _nearest(crowd: DataFrame) -> DataFrame:
    """Pairs of a crowd's member of least f and those that are linked to it whatever they differ in; who is linked so to any member is linked to it."""
    least = crowd.groupBy("lead").agg(F.min(F.struct("g", "node", "comp")).alias("least"))
    known = crowd.select("lead", "salt").distinct().join(least, "lead")
    near = crowd.join(known, ["lead", "salt"]).where("comp <> least.comp AND g + least.g <= 0")
    return near.select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))


def _dealt(crowd: DataFrame, link: int, scratch: Scratch | None = None) -> DataFrame:
    """Buckets of shingles in which members differ from their leader: all links of f(x) + f(y) > |L| share one, at places that leave room for it.

    A bucket is named by the leader, a shingle, and the classes of the two members that meet in it."""
    each = crowd.select("lead", "node", "comp", F.explode("diff").alias("item")).withColumn("salt", _salt())
    parts = each.groupBy("lead", "item", "salt").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # only members of different components need tests, so a shingle that one component has alone tells nothing
    often = parts.groupBy("lead", "item").agg(F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").drop("lo", "hi")
    shared = each.join(parts.select("lead", "item", "salt").join(often, ["lead", "item"]), ["lead", "item", "salt"])
    ordered = shared.groupBy("lead", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("diff"))
    whole = 200 + 2 * link
    kind = F.floor(F.col("g") / (whole * F.ceil(F.col("n_head") * CLASS_SHARE))).cast("int")
    members = written(crowd.drop("diff").join(ordered, ["lead", "node"]).withColumn("d", F.size("diff").cast("long")).withColumn("kind", kind), "members", scratch)
    kinds = members.groupBy("lead", "kind").agg(F.min("g").alias("lo"), F.max("d").alias("most"), F.min("comp").alias("from_"), F.max("comp").alias("to"))
    kinds = kinds.groupBy("lead").agg(F.collect_list(F.struct("kind", "lo", "most", "from_", "to")).alias("kinds"))
    known = members.select("lead", "salt").distinct().join(kinds, "lead")
    met = members.join(known, ["lead", "salt"]).withColumn("met", F.explode("kinds"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("met.lo")) / whole))
    met = met.withColumn("needed", needed).where("needed <= LEAST(d, met.most) AND NOT (met.from_ = comp AND met.to = comp)")
    first = (F.col("d") - F.col("needed") + 1).cast("int")
    posted = met.select("lead", "node", "size", "company", "d", "g", "kind", F.col("met.kind").alias("other"), F.posexplode(F.slice("diff", F.lit(1), first)).alias("at", "item"))
    bucket = F.xxhash64("lead", "item", F.least("kind", "other"), F.greatest("kind", "other"))
    return posted.select(bucket.alias("bucket"), "node", "size", "company", F.col("at").cast("long").alias("at"), "d", "g")


def _joined(found: DataFrame | None, more: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component after more links(a, b), from those before: only components that the links join are worked on."""
    if found is None:
        return components(more, scratch)
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    moved = components(ends, scratch)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = found.join(to, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return written(old.union(moved.join(found, "node", "left_anti").select("node", "component")), "components", scratch)


def links(classes: DataFrame, texts: DataFrame, small: int = SMALL, turns: int = TURNS, last_turns: int = LAST_TURNS, shape: Shape = _SHAPE) -> DataFrame | None:
    """node and component of the components that the links of all pairs of classes at the shape's threshold make.

    classes(node, doc_id, n_shingles, regs), a row for each distinct word sequence; texts(doc_id, text) has theirs."""
    with Scratch(classes.sparkSession) as scratch:
        found = _links(classes, texts, small, turns, last_turns, shape, scratch)
        return None if found is None else written(found, "components")


def _links(classes: DataFrame, texts: DataFrame, small: int, turns: int, last_turns: int, shape: Shape, scratch: Scratch) -> DataFrame | None:
    linked = f"common * 100 >= (sizes - common) * {shape.link}"
    keys = classes.select("node", "regs", "n_shingles").mapInArrow(lambda batches: _banded(batches, shape), "node long, size long, keys array<bigint>")
    members = keys.select("node", "size", F.explode("keys").alias("bucket"))
    # most keys have one member only, and end here
    held = written(_buckets(members), "buckets", scratch)
    wanted = written(held.groupBy("node").agg(F.sum("n").alias("company")), "wanted", scratch)
    # in buckets of bands, two sets can have no more in common than the smaller one has
    held = held.select("bucket", "n", "node", "size", F.lit(0).cast("long").alias("at"), F.col("size").alias("d"), (2 * shape.link * F.col("size")).alias("g"))
    few = held.where(F.col("n") <= small) if turns else None
    held = written((held.where(F.col("n") > small) if turns else held).join(wanted, "node"), "large", scratch)
    # most classes have no company in any band, and none of the pairs to come
    near = written(classes.select("node", "doc_id", "n_shingles", "regs").where(_among(wanted.select(F.col("node").alias("key")))("node")).join(wanted, "node", "left_semi"), "near", scratch)
    # texts stay where they are: who passes in vain is dropped by its node
    found_texts = texts.where(_among(near.select(F.col("doc_id").alias("key")))("doc_id")).select("text")
    sets = written(found_texts.mapInArrow(_sets, "node long, items array<bigint>").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets", scratch)
    tested = found = None

    def test(pairs: DataFrame) -> tuple[int, int]:
        """Verify pairs that were not tested before, and join the components of those linked; the number of both."""
        nonlocal tested, found
        new = pairs.distinct()
        new = written(new if tested is None else new.join(tested, ["a", "b"], "left_anti"), "pairs", scratch)
        if not (n_new := new.count()):
            return 0, 0
        tested = new if tested is None else tested.union(new)
        more = written(similarities(new, near, sets, shape.hopeless).where(linked).select("a", "b"), "linked", scratch)
        if n_more := more.count():
            found = _joined(found, more, scratch)
        return n_new, n_more

    for dealing, n_turns in ((False, turns), (True, last_turns)):
        if dealing:
            crowd = written(_beside_leaders(here.withColumn("lead", F.col("origin")), sets, shape.link), "crowd", scratch)
            test(_nearest(crowd))
            posts = written(_dealt(crowd, shape.link, scratch), "posts", scratch)
            met = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            held = written(posts.join(met, "bucket"), "dealt", scratch)
            few, held = (held.where(F.col("n") <= small), held.where(F.col("n") > small)) if last_turns else (None, held)
        here = None
        for turn in range(n_turns):
            here = written(_open(held, found, turn), "open", scratch)
            stars, ends = _stars(here, shape.link), here.isEmpty()
            if turn == 0:  # small buckets end here
                stars = _pairs_within(few, found, shape.link).union(stars)
            elif ends:
                return found
            n_tested, n_linked = test(stars)
            if ends:
                return found
            held = here
            if n_linked:
                here = None  # components have changed
            # the first turn also tests the pairs of small buckets, which tell nothing of large ones
            if not n_linked or turn and n_linked * WORTH < n_tested:
                break
        # as long as no link has come since, the members of the last turn are those that are open
        if here is None:
            here = written(_open(held, found, 0), "open", scratch)
            if here.isEmpty():
                return found
    test(_all_pairs(here, shape.link))
    return found


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links(a, b) of a batch as links of its nodes to the least of their component there, which is less."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while not np.array_equal(x := root[a], y := root[b]):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, above := root[root]):
                root = above
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[child], pa.int64()), "b": pa.array(nodes[root[child]], pa.int64())})


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and the least node of its component, for every node of edges(a, b): a written table.

    Batches of links are contracted where they lie. Then rounds of large and small stars: neighbours above a node link to its
    least neighbour, until every node has one neighbour below it, or some above it, and not both."""
    long = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = written(long.mapInArrow(_contracted, "a long, b long"), "edges", scratch)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below = F.when(F.col("b") < F.col("a"), F.col("b"))
        near = both.groupBy("a").agg(F.min("b").alias("m"), F.max(below).alias("below"), F.max("b").alias("most"))
        near = written(near.select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.expr("below <> m OR below IS NOT NULL AND most > a").alias("open")), "least", scratch)
        if near.where("open").isEmpty():
            return near.select("node", "component")
        # large star: neighbours greater than the node go to the least of its neighbourhood; all links of now go down
        down = now.select(F.col("b").alias("node"), F.col("a").alias("child"))
        big = written(down.join(near.select("node", "component"), "node").select(F.col("child").alias("a"), F.col("component").alias("b")), "big", scratch)
        # small star: the node and its lesser neighbours go to the least one
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges", scratch)


def _classed(given: DataFrame, link: int, *ids: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of given(*ids, text), doc_id among them, and node, least and component of every class; the least is of the ids, null ones last."""
    shape = shape_for(link)
    rows = written_by_all(given.mapInArrow(lambda batches: _sketched(batches, shape), ", ".join([*(f"{i} long" for i in ids), SKETCH])), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *ids)).alias("least")
    # a class is named by the 64-bit hash of its word sequence
    full = rows.where("n_shingles > 0").groupBy("node").agg(least, F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = written(full.withColumn("doc_id", F.col("least.doc_id")), "classes")
    found = links(classes, given, shape=shape)
    if found is None:
        found = classes.select("node", F.col("node").alias("component"))
    return rows, classes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text), linked from link hundredths on."""
    rows, classes = _classed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), link, "doc_id")
    named = classes.groupBy("component").agg(F.min("least").alias("first"))
    per = classes.join(named, "component").select("node", F.col("first.doc_id").alias("component_id"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("n_shingles > 0").join(per, "node").select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def redundant(rows: DataFrame, link: int = LINK) -> DataFrame:
    """row_no of the rows(row_no, doc_id, text) that are not the first of their component, by doc_id, null last, then row_no.

    Rows without words have no link; those of one id and text are copies all the same."""
    given = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row_no", "text")
    sketched, classes = _classed(given, link, "doc_id", "row_no")
    named = classes.groupBy("component").agg(F.min("least").alias("first"))
    per = classes.join(named, "component").select("node", F.col("first.row_no").alias("first_no"))
    near = sketched.where("n_shingles > 0").join(per, "node").where("row_no <> first_no").select("row_no")
    empty = given.join(sketched.where("n_shingles = 0").select("row_no"), "row_no", "left_semi")
    firsts = empty.groupBy("doc_id", "text").agg(F.min("row_no").alias("row_no"))
    return near.union(empty.select("row_no").join(firsts.select("row_no"), "row_no", "left_anti"))
