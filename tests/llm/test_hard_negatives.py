import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, uid string, cell string"


def brute(rows):
    kept = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    width = max((len(v) for *_, v in kept), default=0)
    m = np.array([v + [0] * (width - len(v)) for *_, v in kept], np.int64).reshape(len(kept), width)
    out = []
    for i, (vec_id, label, _) in enumerate(kept):
        if vec_id % 100:
            continue
        scores = m @ m[i]
        order = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-scores[j], kept[j][0]))
        for p in [j for j in order if kept[j][1] == label][:5]:
            fits = [j for j in order if kept[j][1] != label and 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]]
            out += [(vec_id, kept[p][0], r, kept[j][0], int(scores[p]), int(scores[j])) for r, j in enumerate(fits[:10], 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mined(hard_negatives.from_embeddings(df), F.col("vec_id") % 100 == 0)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def random_rows(n, width, seed, labels=4):
    g = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(g.normal(size=width) / 4)], int(g.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("block", [8192, 150])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "FIT_ROWS", 300)
    rows = random_rows(1500, 12, 1)
    want = brute(rows)
    assert len(want) > 300 and found(spark, rows) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    nan, inf = float("nan"), float("inf")
    rows = random_rows(400, 6, 2)
    # one vector that a third of all rows share, under two labels
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0], i % 2) for i in range(200)]
    rows += [(100, None, 1), (200, [nan, 1.0], 1), (300, [inf, 1.0], 1), (400, [None, 1.0], 1), (500, [0.1] * 6, None), (None, [0.1] * 6, 2)]
    rows += [(700, [0.5, 0.5], 3), (800, [], 3), (900, [0.0] * 6, 3), (900, [0.0] * 6, 3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.5], 1)]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(i * 3)], i % 3) for i in range(120)]
    assert found(spark, rows) == brute(rows)


def test_few_rows_are_sorted_where_bounds_keep_none_out(monkeypatch):
    """Among vectors without clusters every row is met, but only those near a search's k-th score may be put in order."""
    g = np.random.default_rng(5)
    n, searches, k = 3000, 100, 10
    vec = g.integers(-60, 60, size=(n, 64))
    label, anchors = g.integers(0, 10, n), vec[:searches]
    space = hard_negatives.Space(64, int((vec * vec).sum(1).max()), float(np.abs(vec).max()))
    block = hard_negatives.Block(space, np.arange(n), np.arange(n), label, vec)
    lexsort, sizes = np.lexsort, []

    def counted(keys, axis=-1):
        sizes.append(np.asarray(keys[0]).size)
        return lexsort(keys, axis)

    monkeypatch.setattr(np, "lexsort", counted)
    lo, hi = np.zeros(searches, np.int64), np.full(searches, 50_000)
    q, row, score = block.nearest(anchors, label[:searches], np.zeros(searches, bool), np.arange(searches), lo, hi, lo, k)
    want = []
    for i, s in enumerate(anchors @ vec.T):
        fits = np.flatnonzero((label != label[i]) & (s >= 0) & (s <= 50_000))
        want += [(i, int(j), int(s[j])) for j in fits[lexsort((fits, -s[fits]))][:k]]
    assert sorted(zip(q.tolist(), row.tolist(), score.tolist(), strict=True)) == sorted(want)
    assert sum(sizes) < searches * n // 5


@pytest.mark.parametrize("sifted", [50, 1 << 18])
def test_ties_are_sifted_alike(monkeypatch, sifted):
    monkeypatch.setattr(hard_negatives, "SIFTED", sifted)
    g = np.random.default_rng(6)
    vec, label = g.integers(-1, 2, size=(900, 3)), g.integers(0, 3, 900)
    anchors = np.concatenate((vec[:40], np.zeros((10, 3), np.int64)))
    space = hard_negatives.Space(3, 3, 1.0)
    block = hard_negatives.Block(space, np.arange(900), np.arange(900), label, vec)
    lo, hi = np.full(50, -5), np.full(50, 2)
    q, row, score = block.nearest(anchors, label[:50], np.ones(50, bool), np.arange(50), lo, hi, lo, 5)
    want = []
    for i, s in enumerate(anchors @ vec.T):
        fits = [j for j in np.flatnonzero((label == label[i]) & (s <= 2)) if j != i]
        want += [(i, int(j), int(s[j])) for j in sorted(fits, key=lambda j: (-s[j], j))[:5]]
    assert sorted(zip(q.tolist(), row.tolist(), score.tolist(), strict=True)) == sorted(want)
