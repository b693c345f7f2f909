"""I-Match fingerprints and SetSketch near-duplicates."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lodeseek.llm import imatch, registry, setsketch
from lodeseek.llm.common import text_buffer


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, link=85):
    sets = [(i, shingles(t)) for i, t in rows]
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= link * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted((str(d), len(s), str(least[root(i)])) for i, (d, s) in enumerate(sets))


def found(df):
    rows = setsketch.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)


def test_odd_rows(odd, none, odd_rows):
    assert found(odd) == brute([(r[0], r[1]) for r in odd_rows])
    assert found(none) == []


def test_chains_stars_and_crowds(spark):
    """Large buckets: near copies of one text, chains through it, and a crowd that shares a passage without being alike."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(60):  # near copies, a few words changed
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(300)] = word()
        texts.append(t)
    chain = list(base)
    for _ in range(25):  # each like the one before, soon unlike the first
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(chain)
    passage = [word() for _ in range(120)]
    texts += [passage + [word() for _ in range(rng.randint(20, 60))] for _ in range(60)]
    texts += [[word() for _ in range(rng.randint(1, 40))] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def _crowd(rng, copies=150, words=120, shared=12):
    """Copies of one text with words put in, left out and changed, some of the edits shared, and their shingle sets."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(words)]
    common = [(rng.choice("icd"), rng.randrange(words), word()) for _ in range(shared)]
    texts = []
    for _ in range(copies):
        t = list(base)
        edits = [rng.choice(common) if rng.random() < 0.5 else (rng.choice("icd"), rng.randrange(words), word()) for _ in range(rng.randint(0, 7))]
        for kind, at, w in sorted(edits, key=lambda e: -e[1]):
            t[at : at + (kind != "i")] = [] if kind == "d" else [w]
        texts.append(" ".join(t))
    return sorted(set(texts))


def test_dealing_of_crowds_loses_no_link(spark):
    """Every linked pair of a crowd meets in a bucket of first shingles, whoever leads, whatever the threshold."""
    from pyspark.sql import functions as F

    rng = random.Random(21)
    texts = _crowd(rng)
    sets, _ = setsketch.shingles(*text_buffer(pa.array(texts, pa.large_string())))
    items = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, items array<bigint>")
    n = len(texts)
    common = [[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in range(i)] for i in range(n)]
    for link, lead in ((85, 0), (80, 3), (90, n - 1)):
        want = {(j, i) for i in range(n) for j in range(i) if common[i][j] * 100 >= link * (len(sets[i]) + len(sets[j]) - common[i][j])}
        rows = [(1, i, len(sets[i]), 0, i, n, {"node": lead, "comp": lead, "size": len(sets[lead])}) for i in range(n)]
        here = spark.createDataFrame(rows, "bucket long, node long, size long, company long, comp long, n long, lead struct<node:long,comp:long,size:long>")
        crowd = setsketch._beside_leaders(here, items, link).cache()
        dealt = setsketch._dealt(crowd, link).withColumn("comp", F.col("node"))
        dealt = dealt.join(dealt.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        got = {(r.a, r.b) for r in setsketch._all_pairs(dealt, link).distinct().collect()}
        near = {(r.a, r.b) for r in setsketch._nearest(crowd).collect()}
        g = {r.node: r.g for r in crowd.select("node", "g").collect()}
        # what needs no shingle in common is linked, and linked to the nearest member, too
        plain = {(j, i) for i in range(n) for j in range(i) if g[i] + g[j] <= 0}
        hub = min(g, key=lambda i: (g[i], i))
        assert plain <= want and near <= want and near == {(min(i, hub), max(i, hub)) for i in range(n) if i != hub and g[i] + g[hub] <= 0}
        assert {i for p in plain for i in p} <= {i for p in near for i in p}
        assert want - plain <= got and want and len(got) < n * (n - 1) / 2


def test_crowds_beside_the_threshold(spark):
    """Crowds, most of whose pairs are alike but not linked, some only through copies that share an edit."""
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(t for _ in range(2) for t in _crowd(rng, 90))]
    for link in (85, 80):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), link).collect())
        assert got == brute(rows, link)


def test_filters_keep_pairs_beyond_the_threshold():
    """Neither the bands nor the likelihood lose pairs of 0.85 to 0.90: none of 2,000 planted ones."""
    rng = np.random.default_rng(12)
    shape, lost_in_bands, hopeless = setsketch.shape_for(85), 0, 0
    for _ in range(2000):
        n = int(rng.integers(20, 400))
        j = rng.uniform(0.85, 0.90)
        own = int(np.floor(n * (1 - j) / (1 + j)))
        x = rng.integers(0, 1 << 63, n + own).astype(np.uint64)
        a, b = x[:n], x[own:]
        ra, rb = (setsketch.registers(setsketch.minima(s, registers=shape.registers))[None, :] for s in (a, b))
        lost_in_bands += not (setsketch.band_keys(ra, shape) == setsketch.band_keys(rb, shape)).any()
        hopeless += setsketch.likeliest(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0] < shape.hopeless
    assert lost_in_bands == 0 and hopeless == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:2500]
    low = setsketch.minima(a), setsketch.minima(b)
    assert (setsketch.minima(np.concatenate((a, b))) == np.minimum(*low)).all()
    ra, rb = (setsketch.registers(m)[None, :] for m in low)
    assert (setsketch.registers(np.minimum(*low)) == np.maximum(ra, rb)[0]).all()
    j = setsketch.likeliest(ra, rb, np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1500 / 2500) < 0.12
    assert setsketch.likeliest(ra, ra, np.array([2000.0]), np.array([2000.0]))[0] > 0.999


def test_components_of_long_paths(spark):
    rng = random.Random(9)
    nodes = list(range(200))
    rng.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(99)] + [(nodes[i], nodes[150]) for i in range(100, 150)] + [(nodes[160], nodes[161])]
    got = {r.node: r.component for r in setsketch.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(nodes[:100]) for n in nodes[:100]} | {n: min(nodes[100:151]) for n in nodes[100:151]} | {n: min(nodes[160:162]) for n in nodes[160:162]}
    assert got == want


def test_imatch_edits_like_brute_force(spark, sf, odd_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in registry.op4_imatch(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        u = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
    near = np.array([(r.near_edited, r.near_next) for r in got.values()])
    assert ((near >= 0) & (near <= 1)).all()
    assert near[:, 0].mean() > near[:, 1].mean() + 0.2
    by = {}
    for d, t in rows:
        assert by.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def _hash_of_terms(words):
    """Hash of each word by the operator's own byte hashing, a word at a time."""
    return {w: int(imatch.terms(*text_buffer(pa.array([w])))[1][0]) for w in words}


def _mixed(x):
    """The finishing step of splitmix64 in plain integers."""
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def test_imatch_fingerprints_like_brute_force(spark, sf):
    """Both ends of the band cut, and fingerprints and likeness are those of the kept terms, one by one in plain Python."""
    rows = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))) for t in rows]
    count = {}
    for s in sets:
        for w in s:
            count[w] = count.get(w, 0) + 1
    hashes = _hash_of_terms(count)
    got = {r.term: r.n for r in imatch.frequencies(df).collect()}
    assert got == {(h - (1 << 64) if h >= 1 << 63 else h): count[w] for w, h in hashes.items()}
    inside = {w for w, n in count.items() if 2 <= n <= 0.10 * len(rows)}
    rare, common = {w for w, n in count.items() if n < 2}, {w for w, n in count.items() if n > 0.10 * len(rows)}
    band = imatch.lexicon(df)
    has = dict(zip(hashes, band.has(np.array(list(hashes.values()), np.uint64)).tolist(), strict=True))
    assert all(has[w] for w in inside) and sum(has[w] for w in rare) <= 0.01 * len(rare) + 2 and sum(has[w] for w in common) <= 2
    assert len(rare) > 100 and len(common) > 20
    whole, short = imatch.fingerprints(rows, band)
    salts = [int(x) for x in imatch._SALTS]
    want = []
    for s in sets[:60]:
        kept = [hashes[w] for w in s if has[w]]
        kept = kept if len(kept) >= imatch.MIN_TERMS else [hashes[w] for w in s]
        subsets = []
        for level in range(imatch.LEVELS):
            for salt in salts:
                v = [_mixed(h ^ salt) for h in kept]
                v = [_mixed(x) | 1 << 63 for x in v if x < (1 << 64) >> 2 * (level + 1)]
                total = sum(v) & (1 << 64) - 1
                subsets.append(0 if total == 0 else _mixed(total) >> 48 or 1)
        want.append((_mixed(sum(map(_mixed, kept)) & (1 << 64) - 1), subsets))
    assert [(int(a), b.tolist()) for a, b in zip(whole[:60], short[:60], strict=True)] == want
    # the likeness of estimated and true shares of kept terms
    kept = [{w for w in s if has[w]} for s in sets]
    big = [i for i in range(len(rows)) if len(kept[i]) >= 40]
    for i, j in zip(big, big[1:]):
        true = len(kept[i] & kept[j]) / len(kept[i] | kept[j])
        told = imatch.likeness(whole[[i]], short[[i]], whole[[j]], short[[j]])[0]
        assert abs(told - true) < 0.45 if true < 1 else told == 1.0


def test_imatch_odd_rows(odd, none, odd_rows):
    got = imatch.compared(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint
    assert by[3].n_chars == by[4].n_chars == 0 and by[3].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].near_next == 1.0  # both empty
    assert imatch.compared(none).collect() == []
    assert len(imatch.compared(odd.where("doc_id = 1")).collect()) == 1


def test_imatch_likeness_follows_shared_terms():
    words = [f"w{i}x" for i in range(900)]
    texts = [" ".join(words[:300]), " ".join(words[:200] + words[600:700]), " ".join(words[300:600]), " ".join(reversed(words[:300]))]
    whole, short = imatch.fingerprints(texts, None)
    at = lambda i, j: imatch.likeness(whole[[i]], short[[i]], whole[[j]], short[[j]])[0]
    assert at(0, 3) == 1.0
    assert 0.25 < at(0, 1) < 0.8
    assert at(0, 2) < 0.15


def test_shingle_hashes_like_sets():
    texts = ["a b c d e f", "A b C d e f", "", None, "one two", "a b c d e a b c d e a b c d e"]
    sets, digest = setsketch.shingles(*text_buffer(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert digest[0] == digest[1] and digest[0] != digest[5]


def test_keys_among_others(spark, monkeypatch):
    """Every key passes, null ones too, few others do; with a bitmap that is too small all keys still pass."""
    keys = [*range(-3000, 3000, 3), None, 2**62]
    rows = spark.createDataFrame([(x,) for x in [*range(-20000, 20000), None, 2**62, -(2**63)]], "x long")
    given = spark.createDataFrame([(k,) for k in keys], "key long")
    for bits in (26, 6):
        monkeypatch.setattr(setsketch, "MOST_BITS", bits)
        passed = [r.x for r in rows.where(setsketch._among(given)("x")).collect()]
        assert set(keys) <= set(passed) and len(passed) == len(set(passed))
        assert len(passed) < len(keys) + 2000 or bits == 6
    none = rows.where(setsketch._among(given.limit(0))("x"))
    assert none.count() == 0


def test_small_tables_take_few_writers_and_rounds(spark, monkeypatch):
    """With many shuffle partitions, tables of a turn are written by few tasks, and links that lie together take no round of stars."""
    from pyspark.sql import functions as F

    many = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in many}
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        counts = spark.range(3000).groupBy((F.col("id") % 1000).alias("k")).count()
        assert len(setsketch.written(counts, "counts").inputFiles()) <= max(26, 4 * spark.sparkContext.defaultParallelism)
        names, put = [], setsketch.written
        monkeypatch.setattr(setsketch, "written", lambda df, name, within=None: names.append(name) or put(df, name, within))
        links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70), (60, 50)], "a long, b long").coalesce(1)
        got = {r.node: r.component for r in setsketch.components(links).collect()}
        assert got == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50} and len(names) == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_pairs_of_small_buckets(spark):
    """Pairs within small buckets are those that pairing by parts finds, whatever is linked already."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(b, i, rng.choice((100, 101, 90, 60)), 0, rng.randint(0, 60)) for b in range(40) for i in rng.sample(range(30), rng.randint(2, 6))]
    held = spark.createDataFrame(rows, "bucket long, node long, size long, company long, at long").withColumns({"d": F.col("size"), "g": 2 * 85 * F.col("size")})
    held = held.join(held.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    for found in (None, spark.createDataFrame([(i, i % 3) for i in range(9)], "node long, component long")):
        want = {(r.a, r.b) for r in setsketch._all_pairs(setsketch._open(held, found, 1), 85).collect()}
        assert {(r.a, r.b) for r in setsketch._pairs_within(held, found, 85).collect()} == want != set()


def test_turns_end_where_they_link_hardly_anything(spark, monkeypatch):
    """A crowd that no turn links is told its leaders twice at most before it is dealt, and once after; rows grow with the members, and results are whole."""
    for members in (40, 80):
        rng = random.Random(11)
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
        base, passage = [word() for _ in range(200)], [word() for _ in range(120)]
        texts = [passage + [word() for _ in range(rng.randint(20, 40))] for _ in range(members)]
        texts += [base[:i] + [word()] + base[i + 1 :] for i in rng.sample(range(200), 10)]
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        sizes, put = {}, setsketch.written
        with monkeypatch.context() as patched:
            patched.setattr(setsketch, "written", lambda df, name, within=None: sizes.setdefault(name, []).append(put(df, name, within)) or sizes[name][-1])
            # before the tables of the run go, none is counted: the last one, of components, is made within
            counts, leave = {}, setsketch.Scratch.__exit__
            patched.setattr(setsketch.Scratch, "__exit__", lambda self, *a: counts.update({n: [t.count() for t in sizes.get(n, [])] for n in ("open", "large", "dealt")}) or leave(self, *a))
            got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect())
        assert got == brute(rows, 80)
        assert counts["large"][0] >= 2 * members and len(counts["dealt"]) == 1
        assert sum(counts["open"]) <= 2 * counts["large"][0] + counts["dealt"][0], counts
