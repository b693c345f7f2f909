"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A row x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, and an anchor q gets 0 there, so
|q' - x'|^2 = |q|^2 + M - 2 q.x: the nearest row has the highest score, and a window of scores is an annulus of
distances. A tree over vantage points bounds those distances by the triangle inequality.

The tree has two storeys. The upper one, fitted on at most FIT_ROWS rows of least hash, has at most CELLS cells; every
row goes to its cell, and each cell is dealt into blocks of about BLOCK rows. The lower one is built in each block over
all its rows, down to leaves of LEAF rows. A search goes to the blocks of its nearest cell first; the score of its k-th
row then keeps it out of all cells whose bound is worse, and the rest get it in a second turn. Within a block, searches
take its leaves nearest first (a batch of searches at a time, twice as many leaves in each turn), skip those outside of
their annulus, and end when the next bound is beyond their k-th row. Bounds only ever skip rows that cannot be in a
result, so results are exact. How much they skip is up to the vectors: where those have clusters, most leaves; among
vectors that point anywhere in many dimensions, hardly any, and then anchors times rows inner products are made.

A block is the state of one task while its searches stream past; no group of searches is gathered. Of rows with the
same vector and label only the MOST first by vec_id can be in a result, as equal rows have equal scores; the others
are left out of the index before it is dealt, so a vector that a third of all rows share is a handful of rows there.
They are still anchors.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; rows with a
null vec_id neither; a vector shorter than another counts as padded with zeros; scores are exact while sums of products
fit in 64 bits; repeated rows are rows of their own, and an anchor is only kept from itself, not from its copies;
anchors without positives, and positives without negatives, have no rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, written

FIT_ROWS, CELLS, BLOCK, LEAF = 4096, 64, 8192, 96
#: Relative slack of bounds, far above the rounding of distances.
SLACK = 1e-6
_WIDE = float(1 << 62)


# ---------------------------------------------------------------- vectors


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros."""
    flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat, off = flat[off[0] : off[-1]], off - off[0]
    n, size = len(column), np.diff(off)
    if n and (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    out[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
    return out


class Space:
    """Distances of augmented vectors: how wide they are, the largest squared norm, and the narrowest numbers that hold all inner products exactly."""

    def __init__(self, width: int, most: int, largest: float):
        self.width, self.most = width, float(most)
        sums = width * largest * largest
        self.exact = np.float32 if sums < 2.0**23 else np.float64 if sums < 2.0**52 else np.int64

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(1)))))

    def of_anchor(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q.astype(np.float64), np.zeros(len(q))))

    def distance(self, squared: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of rows with that score from anchors with that squared norm."""
        return np.sqrt(np.maximum(0.0, squared + self.most - 2.0 * score))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


# ---------------------------------------------------------------- trees


class Tree:
    """Vantage points with, for each side, the least and largest distance of its rows; sides end in leaves of rows."""

    def __init__(self, rows: np.ndarray, leaf: int):
        self.points: list[int] = []
        self.near: list[float] = []  # the radius that parts a node's sides
        self.low, self.high, self.paths, self.leaves = [], [], [], []
        stack: list[tuple[np.ndarray, list[tuple[int, int]]]] = [(np.arange(len(rows)), [])]
        while stack:
            these, path = stack.pop()
            if len(these) <= leaf:
                self.leaves.append(these)
                self.paths.append(path)
                continue
            # the row farthest from the first one sees its neighbours at distances that differ
            point = int(these[apart(rows[these[:1]], rows[these])[0].argmax()])
            d = apart(rows[point : point + 1], rows[these])[0]
            order = np.argsort(d, kind="stable")
            cut = len(order) // 2
            node = len(self.points)
            self.points.append(point)
            self.near.append(float(d[order[cut - 1]]))
            sides = (order[:cut], order[cut:])
            self.low.append([float(d[s].min()) for s in sides])
            self.high.append([float(d[s].max()) for s in sides])
            stack += [(these[s], [*path, (node, k)]) for k, s in enumerate(sides)]
        self.vantage = rows[self.points] if self.points else np.zeros((0, rows.shape[1]))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each search and leaf, the least and largest distance that its rows can have."""
        d = apart(q, self.vantage)
        low, high = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        for k, path in enumerate(self.paths):
            for node, side in path:
                x, lo, hi = d[:, node], self.low[node][side], self.high[node][side]
                np.maximum(low[:, k], np.maximum(x - hi, lo - x), out=low[:, k])
                np.minimum(high[:, k], x + hi, out=high[:, k])
        return low, high

    def cell(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by radii; distances of rows from the vantage points of their paths widen the bounds."""
        d = apart(rows, self.vantage)
        out = np.zeros(len(rows), np.int64)
        open_ = np.ones(len(rows), bool)
        for k, path in enumerate(self.paths):
            here = open_.copy()
            for node, side in path:
                here &= (d[:, node] > self.near[node]) == bool(side)
            out[here] = k
            open_ &= ~here
        return out


class Cells:
    """The upper storey: its tree, and of each cell and vantage point the least and largest distance of all rows."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.low = np.full((len(tree.leaves), len(tree.points)), np.inf)
        self.high = np.full((len(tree.leaves), len(tree.points)), -np.inf)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros((len(q), len(self.low))), np.full((len(q), len(self.low)), np.inf)
        if self.tree.points:
            d = apart(q, self.tree.vantage)
            for k in range(len(self.low)):
                low[:, k] = np.maximum(0.0, np.maximum(d - self.high[k], self.low[k] - d).max(1))
                high[:, k] = (d + self.high[k]).min(1)
        return low, high


# ---------------------------------------------------------------- searches in a block


#: Candidates of a batch of searches are sifted to k for each when there are so many, whatever ties make of them.
SIFTED = 1 << 18


class Block:
    """The lower storey over one block's rows, in (vec_id, uid) order; leaf by leaf beside it, in numbers that hold inner products."""

    def __init__(self, space: Space, uid, vec_id, label, vec: np.ndarray):
        order = np.lexsort((uid, vec_id))
        self.uid, self.vec_id, self.label = uid[order], vec_id[order], label[order]
        raised = space.raised(vec[order])
        self.space, self.tree = space, Tree(raised, LEAF)
        self.leaves = [np.sort(x) for x in self.tree.leaves]
        self.vecs = [np.ascontiguousarray(vec[order[x]].astype(space.exact).T) for x in self.leaves]

    def nearest(self, vec, label, same, uid, lo, hi, floor, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each search its k best rows here: (search, row, score). floor: no lower score can be of use.

        Each turn takes twice as many leaves as the last one, nearest first, so that where bounds keep little out, as
        among vectors without clusters, most rows meet the k-th score of half of them and only few are looked at twice."""
        n, space = len(vec), self.space
        squared = (vec.astype(np.float64) ** 2).sum(1)
        low, high = self.tree.bounds(space.of_anchor(vec))
        slack = SLACK * (np.sqrt(space.most) + np.sqrt(squared) + 1.0)
        nearest = space.distance(squared, np.minimum(hi, _WIDE)) - slack
        scores = np.full((n, k), -(1 << 62), np.int64)
        rows = np.full((n, k), len(self.uid), np.int64)
        order = np.argsort(low, axis=1, kind="stable")
        asked, wanted = vec.astype(space.exact), np.maximum(lo, floor)
        turn, many = 0, 1
        while turn < order.shape[1]:
            farthest = space.distance(squared, np.maximum(np.maximum(wanted, scores[:, -1]), -_WIDE)) + slack
            these = order[:, turn : turn + many]
            near = np.take_along_axis(low, these, 1) <= farthest[:, None]
            if not near.any():
                break
            going = np.zeros(low.shape, bool)
            np.put_along_axis(going, these, near & (np.take_along_axis(high, these, 1) >= nearest[:, None]), 1)
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0
            for leaf in np.flatnonzero(going.any(0)):
                some, members = np.flatnonzero(going[:, leaf]), self.leaves[leaf]
                least = np.maximum(wanted[some], scores[some, -1])
                s = asked[some] @ self.vecs[leaf]
                i, c = np.nonzero(s >= least.astype(space.exact)[:, None])
                q, row, score = some[i], members[c], s[i, c].astype(np.int64)
                fits = (self.label[row] == label[q]) == same[q]
                # rows are numbered by vec_id, so ties go to the smaller one
                fits &= (self.uid[row] != uid[q]) & (score <= hi[q]) & ((score > scores[q, -1]) | (row < rows[q, -1]))
                held.append((q[fits], row[fits], score[fits]))
                size += len(held[-1][0])
                if size > SIFTED:
                    self._sift(held, scores, rows)
                    held, size = [], 0
            if size:
                self._sift(held, scores, rows)
            turn, many = turn + many, 2 * many
        q, c = np.nonzero(rows < len(self.uid))
        return q, rows[q, c], scores[q, c]

    @staticmethod
    def _sift(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], scores: np.ndarray, rows: np.ndarray) -> None:
        """Take candidates (search, row, score) into each search's best ones, in place."""
        k = scores.shape[1]
        q, row, score = (np.concatenate(x) for x in zip(*held, strict=True))
        some = np.unique(q)
        q = np.concatenate((np.repeat(some, k), q))
        row, score = np.concatenate((rows[some].ravel(), row)), np.concatenate((scores[some].ravel(), score))
        order = np.lexsort((row, -score, q))
        q, row, score = q[order], row[order], score[order]
        # every search has its k former ones here at least, so its first k are never another's
        at = (np.searchsorted(q, some)[:, None] + np.arange(k)).ravel()
        scores[some], rows[some] = score[at].reshape(-1, k), row[at].reshape(-1, k)


# ---------------------------------------------------------------- Spark


class Index:
    """Every row in its block, written; and the upper storey, which is of fixed size."""

    def __init__(self, rows: DataFrame, most: int, scratch: Scratch):
        first = Window.partitionBy("label", "vec").orderBy("vec_id", "uid")
        kept = scratch.written(rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).drop("nth"), "kept")
        square = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
        peak = F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x))), F.lit(0))
        n, width, norm, largest = kept.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(square), F.max(peak)).first()
        self.space = Space(width or 0, norm or 0, float(largest or 0))
        space, self.n = self.space, n
        sample = kept.orderBy(F.xxhash64("vec_id", "uid")).limit(FIT_ROWS).select("vec").toArrow()["vec"].combine_chunks()
        cells = max(1, min(CELLS, n // BLOCK))
        fitted = space.raised(matrix(sample, space.width)) if len(sample) else np.zeros((0, space.width + 1))
        tree = Tree(fitted, max(1, -(-len(fitted) // cells)))
        self.cells = Cells(tree)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = space.raised(matrix(b.column(3), space.width))
                    d = apart(x, tree.vantage)
                    ends = pa.array(np.arange(0, d.size + 1, d.shape[1] or 1)[: len(x) + 1] if d.shape[1] else np.zeros(len(x) + 1), pa.int32())
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.cell(x), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], [*b.schema.names, "cell", "away"])

        dealt = scratch.written(kept.select("uid", "vec_id", "label", "vec").mapInArrow(assign, "uid long, vec_id long, label long, vec array<long>, cell int, away array<double>"), "dealt")
        # one row for each cell and vantage point: CELLS squared at most
        ranges = dealt.select("cell", F.posexplode("away").alias("point", "d")).groupBy("cell", "point").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        for r in ranges.collect():
            self.cells.low[r.cell, r.point], self.cells.high[r.cell, r.point] = r.lo, r.hi
        sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
        self.blocks = [max(1, -(-sizes.get(c, 0) // BLOCK)) for c in range(len(tree.leaves))]
        count = F.element_at(F.array(*map(F.lit, self.blocks)), F.col("cell") + 1)
        self.rows = dealt.select("cell", F.pmod(F.xxhash64("uid"), count).cast("int").alias("block"), "uid", "vec_id", "label", "vec")

    def search(self, asks: DataFrame, k: int, scratch: Scratch) -> DataFrame:
        """The k best rows (qid, rank, uid, vec_id, score) for each of asks(qid, vec, label, same, uid, lo, hi)."""
        space, cells, blocks = self.space, self.cells, self.blocks

        def routed(first: bool):
            def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    vec = matrix(b.column(1), space.width)
                    lo, hi, floor = (b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (5, 6, 7))
                    squared = (vec.astype(np.float64) ** 2).sum(1)
                    slack = SLACK * (np.sqrt(space.most) + np.sqrt(squared) + 1.0)
                    low, high = cells.bounds(space.of_anchor(vec))
                    inside = high >= (space.distance(squared, hi) - slack)[:, None]
                    inside &= low <= (space.distance(squared, np.maximum(lo, floor)) + slack)[:, None]
                    nearest = np.where(inside, low, np.inf).argmin(1)
                    here = np.zeros_like(inside)
                    here[np.arange(len(vec)), nearest] = True
                    ask, cell = np.nonzero(inside & (here if first else ~here))
                    many = np.array(blocks, np.int64)[cell]
                    ask, cell = np.repeat(ask, many), np.repeat(cell, many)
                    part = np.arange(len(ask)) - np.repeat(np.cumsum(many) - many, many)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(part, pa.int32()), *b.take(pa.array(ask)).columns], ["cell", "block", *b.schema.names])

            return route

        given = "qid long, vec array<long>, label long, same boolean, uid long, lo long, hi long, floor long"

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of blocks and searches of the same blocks, sorted so that a block's rows come first."""
            where, held, block = None, [], None
            for b in batches:
                keys = np.stack([b.column(i).to_numpy() for i in (0, 1)]) if b.num_rows else np.zeros((2, 0), np.int64)
                asked = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                change = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0) | (np.diff(asked) != 0)) + 1 if b.num_rows else []
                for i, j in zip([0, *change], [*change, b.num_rows], strict=True):
                    if i == j:
                        continue
                    if (at := tuple(keys[:, i])) != where:
                        where, held, block = at, [], None
                    part = b.slice(i, j - i)
                    if not asked[i]:
                        held.append(part)
                        continue
                    if block is None and held:
                        t = pa.Table.from_batches(held)
                        ints = [t.column(c).to_numpy() for c in ("uid", "vec_id", "label")]
                        block, held = Block(space, *ints, matrix(t.column("vec").combine_chunks(), space.width)), []
                    if block is None:
                        continue
                    step = 512
                    for s in range(0, part.num_rows, step):
                        some = part.slice(s, step)
                        c = {n: some.column(i) for i, n in enumerate(some.schema.names)}
                        num = lambda n: c[n].to_numpy(zero_copy_only=False)  # noqa: E731, B023
                        q, row, score = block.nearest(matrix(c["vec"], space.width), num("label"), num("same").astype(bool), num("uid"), num("lo"), num("hi"), num("floor"), k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (num("qid")[q], block.uid[row], block.vec_id[row], score)], ["qid", "uid", "vec_id", "score"])

        null = lambda kind: F.lit(None).cast(kind)
        stored = self.rows.select(
            "cell", "block", F.lit(False).alias("asked"), null("long").alias("qid"), "vec", "label", null("boolean").alias("same"), "uid",
            null("long").alias("lo"), null("long").alias("hi"), null("long").alias("floor"), "vec_id",
        )
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "uid")
        parts = max(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sum(blocks))

        def turn(asks: DataFrame, first: bool) -> DataFrame:
            sent = asks.select(*[c.split()[0] for c in given.split(", ")]).mapInArrow(routed(first), f"cell int, block int, {given}")
            sent = sent.select("cell", "block", F.lit(True).alias("asked"), "qid", "vec", "label", "same", "uid", "lo", "hi", "floor", null("long").alias("vec_id"))
            both = stored.unionByName(sent).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "asked")
            return both.mapInArrow(met, "qid long, uid long, vec_id long, score long")

        first = scratch.written(turn(asks.withColumn("floor", F.col("lo")), True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "first")
        if len(blocks) > 1:
            kth = first.groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") >= k).select("qid", F.col("least").alias("floor"))
            more = asks.join(kth, "qid", "left").withColumn("floor", F.coalesce("floor", "lo"))
            first = first.unionByName(turn(more, False))
        return scratch.written(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best")


def whole(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def takes_part(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of rows(vec_id, label, vec of whole numbers): low and high are percentages of the positive's score.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    with Scratch(rows.sparkSession) as scratch:
        known = scratch.written(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.col("label").cast("long").alias("label"), "vec"), "vectors")
        # an anchor may be among the first of its copies
        index = Index(known, max(positives + 1, negatives), scratch)
        anchors = known.where(is_anchor)
        wide = (F.lit(-(1 << 61)).cast("long").alias("lo"), F.lit(1 << 61).cast("long").alias("hi"))
        friends = index.search(anchors.select(F.col("uid").alias("qid"), "vec", "label", F.lit(True).alias("same"), "uid", *wide), positives, scratch)
        pairs = anchors.select("uid", F.col("vec_id").alias("anchor_id"), "label", "vec").join(friends.select(F.col("qid").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "uid")
        windows = scratch.written(pairs.withColumn("qid", F.monotonically_increasing_id()), "windows")
        # 100 s >= low p and 100 s <= high p, in whole scores
        least, most = (F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100L)) div 100L)"), F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100L"))
        asks = windows.select("qid", "vec", "label", F.lit(False).alias("same"), "uid", least.alias("lo"), most.alias("hi")).where("lo <= hi")
        found = index.search(asks, negatives, scratch).select("qid", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = windows.select("qid", "anchor_id", "positive_id", "positive_score").join(found, "qid")
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")


def from_embeddings(table: DataFrame) -> DataFrame:
    """vec_id, label and whole vectors of the rows of table(vec_id, embedding, label) that take part; every seventh label is wrong by one."""
    rows = table.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.select("vec_id", label.alias("label"), whole(F.col("embedding")).alias("vec"))
