import random

from lodeseek.operators import diff, windows


def test_innermost_like_all_pairs(spark):
    g = random.Random(5)
    scopes, points = [], []
    for f in range(6):
        stack = [(0, 400)]
        while stack:
            lo, hi = stack.pop()
            if hi - lo < 4 or g.random() < 0.1:
                continue
            scopes.append((f, lo, hi, f"{f}:{lo}-{hi}"))
            mid = g.randrange(lo + 1, hi)
            stack += [(lo + g.randrange(2), mid - 1), (mid, hi - g.randrange(2))]
        points += [(f, g.randrange(-5, 410), k) for k in range(80)] + [(f, None, 99)]
    points += [(None, 5, 1), (9, 5, 1)]
    want = []
    for f, at, k in points:
        around = [s for s in scopes if s[0] == f and at is not None and s[1] <= at <= s[2]]
        want.append((f, at, k, min(around, key=lambda s: s[2] - s[1])[3] if around else None))
    got = diff.innermost(spark.createDataFrame(points, "f int, at int, k int").repartition(3), spark.createDataFrame(scopes, "f int, scope_start int, scope_end int, scope string"), ["f"])
    assert sorted(map(str, map(tuple, got.select("f", "at", "k", "scope").collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_heights_over_everything(spark):
    rows = [(i, (i * 7) % 5 if i % 11 else None) for i in range(300)] + [(300, 4), (300, 4)]
    h = windows.Heights(spark.createDataFrame(rows, "k int, units int").repartition(5), ["k"])
    got = h.rows.orderBy("k", "top").collect()
    top = 0
    for (k, units), r in zip(rows, got, strict=True):
        assert (r.k, r.top, r.bottom) == (k, top, top + (units or 0))
        top = r.bottom
    for offset in (0, 1, 17, 250, top - 1):
        want = [r.k for r in got if r.top <= offset < r.bottom]
        assert [r.k for r in h.row_at(offset).collect()] == want and len(want) == 1
    assert h.row_at(top).count() == 0 and h.between(100, 130).count() == sum(r.top < 130 and r.bottom > 100 for r in got)
    assert "PartitionFilters: [" in (plan := h.row_at(17)._jdf.queryExecution().executedPlan().toString()) and "page" in plan
    assert windows.Heights(spark.createDataFrame([], "k int, units int"), ["k"]).row_at(0).count() == 0
