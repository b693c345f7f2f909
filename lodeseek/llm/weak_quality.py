"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Expectation maximisation over the counts of vote
patterns (at most 3 ** labellers of them, whatever the input) estimates how often each labeller votes how in either
class. The posteriors label a bounded sample, on which a linear scorer over hashed word shapes and binned statistics
is trained; it then scores every document.

Defined results: null and empty texts have score 0 and are not kept; a statistic equal to a limit votes as one beyond
it, a score equal to KEEP_FROM keeps; very long texts are taken whole, one at a time; extra columns are ignored;
repeated rows each get their row and the same score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, byte_table, give_back, sample_share, slices, span_hashes, text_buffer, word_spans

#: Documents, about, on which the scorer is fitted; the labellers and the estimation see all.
FIT_DOCUMENTS = 4_000
KEEP_FROM = 0.12
BUCKETS = 1 << 14
BINS = 12

#: Marks that prose seldom holds in number.
MARKS = b"#%&$*|!^~@<>{}[]\\_="
LABELLERS = ("marks", "separators", "capitals", "shouting", "distinct_words", "repeated_lines", "top_word", "decorated", "letters", "echoes")
#: For each labeller: its statistic is bad from the first limit on and good up to the second, else it abstains.
LIMITS = {
    "marks": (0.03, 0.005),
    "separators": (0.08, 0.01),
    "capitals": (0.35, 0.12),
    "shouting": (0.15, 0.0),
    "distinct_words": (0.50, 0.35),
    "repeated_lines": (0.35, 0.10),
    "top_word": (0.30, 0.15),
    "decorated": (0.15, 0.01),
    "letters": (0.35, 0.28),
    "echoes": (0.20, 0.02),
}
#: On shorter texts most labellers abstain.
FEW_WORDS = 20

#: What is held of a labeller before any votes are seen, for bad and good documents: it seldom blames a good one. It
#: weighs as this share of all documents and keeps the classes from changing places.
PRIOR = np.array([[0.20, 0.40, 0.40], [0.10, 0.895, 0.005]])
PRIOR_SHARE = 0.05

_MARK = np.zeros(256, np.int64)
_MARK[list(MARKS)] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_OTHER = np.zeros(256, np.int64)
_OTHER[128:] = 1
_LETTER = _UPPER + _LOWER + _OTHER
_NEWLINE = byte_table(b"\n")
#: Shape of a byte: capital, small, digit, other alphabets, then punctuation by its value.
_SHAPE = np.arange(256, dtype=np.int64) % 61 + 4
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 0, 1, 2, 3


def _totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one stands."""
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=rows), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Each labeller's statistic for each row, and the words they are taken from."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, SPACE)
    words = np.diff(first)
    row = np.repeat(np.arange(rows), words)
    size = np.diff(offsets)
    letters, upper = _totals(_LETTER[data], offsets), _totals(_UPPER[data], offsets)
    last, last2 = data[ends - 1] if len(ends) else data[:0], data[np.maximum(ends - 2, starts)] if len(ends) else data[:0]
    mark_end = (_MARK[last] & _MARK[last2]).astype(bool) & (ends - starts > 2)
    alone = (ends - starts == 1) & (_MARK[last] == 1)
    count = lambda m: np.bincount(row[m], minlength=rows)
    hashes = span_hashes(data, starts, ends)
    distinct, top = _distinct(row, hashes, rows)
    echo = np.zeros(len(row), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    ls, le, lfirst = word_spans(data, offsets, _NEWLINE)
    lines = np.diff(lfirst)
    line_distinct, _ = _distinct(np.repeat(np.arange(rows), lines), span_hashes(data, ls, le), rows)
    long_enough = words >= FEW_WORDS
    # longer texts repeat more of their words: a vocabulary grows as a power of the length
    usual = np.maximum(words, 1) ** 0.92
    out = {
        "marks": np.where(long_enough, _share(_totals(_MARK[data], offsets), size), 0.01),
        "separators": _share(count(alone), words),
        "capitals": np.where(long_enough, _share(upper, letters), 0.2),
        "shouting": _share(count((last == 33) & (last2 == 33)), words),
        "distinct_words": np.where(long_enough, np.maximum(0, 1 - distinct / usual), 0.4),
        "repeated_lines": np.where(lines > 1, 1 - _share(line_distinct, lines), 0.2),
        "top_word": np.where(long_enough, _share(top, words), 0.2),
        "decorated": _share(count(mark_end), words),
        "letters": np.where(long_enough, 1 - _share(letters, size), 0.3),
        "echoes": np.where(words > 1, _share(count(echo), words), 0.1),
    }
    return out, {"words": words, "row": row, "starts": starts, "ends": ends}


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Vote patterns as numbers: base 3, a digit for each labeller: 0 abstains, 1 good, 2 bad."""
    pattern = np.zeros(len(next(iter(stats.values()))), np.int64)
    for name in LABELLERS:
        bad, good = LIMITS[name]
        pattern = pattern * 3 + np.where(stats[name] >= bad, 2, np.where(stats[name] <= good, 1, 0))
    return pattern


def digits(patterns: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return (patterns[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation. Returns each pattern's posterior of good, P(vote | class) as (class, labeller, vote), the share of good."""
    d, k = digits(patterns), len(LABELLERS)
    one_hot = d[:, :, None] == np.arange(3)
    theta = np.repeat(PRIOR[:, None], k, axis=1)
    good, post, before = 0.8, np.zeros(len(patterns)), -np.inf
    total = counts.sum()
    for _ in range(rounds if total else 0):
        logs = np.log(theta)
        l1 = np.log(good) + (one_hot * logs[1]).sum((1, 2))
        l0 = np.log1p(-good) + (one_hot * logs[0]).sum((1, 2))
        top = np.maximum(l0, l1)
        norm = top + np.log(np.exp(l0 - top) + np.exp(l1 - top))
        post = np.exp(l1 - norm)
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            theta[c] = (w[:, None, None] * one_hot).sum(0) + PRIOR[c] * PRIOR_SHARE * total
            theta[c] /= theta[c].sum(-1, keepdims=True)
        good = float(np.clip((counts * post).sum() / total, 0.01, 0.99))
        if (now := float((counts * norm).sum())) - before < 1e-7 * total:
            break
        before = now
    return post, theta, good


def features(data: np.ndarray, offsets: np.ndarray, stats: dict, words: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (row, bucket, value): shapes of words, as shares of the words, and a feature for the bin of each statistic."""
    rows, s, e = len(offsets) - 1, words["starts"], words["ends"]
    shape = np.zeros(len(s), np.int64)
    if len(s):
        for at in (s, np.minimum(s + 1, e - 1), np.maximum(e - 2, s), e - 1):
            shape = shape * 65 + _SHAPE[data[at]]
    bucket = (shape * 2654435761 >> 7) % (BUCKETS - len(LABELLERS) * BINS)
    value = 1.0 / np.maximum(words["words"], 1)[words["row"]]
    at = BUCKETS - len(LABELLERS) * BINS
    r, b, v = [words["row"]], [bucket], [value]
    for i, name in enumerate(LABELLERS):
        bins = np.minimum((np.sqrt(np.clip(stats[name], 0, 1)) * BINS).astype(np.int64), BINS - 1)
        r.append(np.arange(rows))
        b.append(at + i * BINS + bins)
        v.append(np.full(rows, 0.5))
    return np.concatenate(r), np.concatenate(b), np.concatenate(v)


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated full-batch gradient descent. Classes count alike."""
    w, b, n = np.zeros(BUCKETS), 0.0, max(1, len(target))
    good = float(np.clip(target.mean() if len(target) else 0.5, 0.02, 0.98))
    weight = target * 0.5 / good + (1 - target) * 0.5 / (1 - good)
    vw, vb = np.zeros(BUCKETS), 0.0
    for _ in range(rounds if len(target) else 0):
        z = np.bincount(row, value * (w + 0.9 * vw)[bucket], minlength=len(target)) + b + 0.9 * vb
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight / n
        vw = 0.9 * vw - rate * (np.bincount(bucket, value * g[row], minlength=BUCKETS) + decay * w)
        vb = 0.9 * vb - rate * 0.25 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, int] = {}
    for part in slices(batches, "text", 1 << 20):
        stats, _ = statistics(*text_buffer(part.column(0)))
        for p, c in zip(*np.unique(votes(stats), return_counts=True), strict=True):
            seen[int(p)] = seen.get(int(p), 0) + int(c)
    yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})


def _rows_of_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 1 << 20):
        data, off = text_buffer(part.column(0))
        stats, words = statistics(data, off)
        r, b, v = features(data, off, stats, words)
        keys, inverse = np.unique(r * BUCKETS + b, return_inverse=True)
        values = np.bincount(inverse, v).astype(np.float32)
        cut = np.searchsorted(keys, np.arange(part.num_rows + 1) * BUCKETS)
        b = (keys % BUCKETS).astype(np.uint16)
        yield pa.RecordBatch.from_pydict({
            "pattern": pa.array(votes(stats)),
            "buckets": pa.array([b[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            "shares": pa.array([values[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        })


def train(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> dict:
    """Estimate the labellers on all of docs(doc_id, text), then fit the scorer. The model is of fixed size."""
    text = docs.select("text")
    found = text.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    patterns, counts = found["pattern"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    post, theta, good = estimate(patterns, counts)
    share = min(1.0, fit_documents / max(1.0, counts.sum()))
    sample = docs.where(sample_share(["doc_id", "text"], share)).select("text").orderBy(F.xxhash64("text", F.lit(3)), "text").limit(4 * fit_documents)
    # the sample is fitted where it lies: only the weights come to the driver
    got = sample.coalesce(1).mapInArrow(_fitting(patterns, post), "weights binary, bias double").collect()
    w, b = (np.frombuffer(bytes(got[0]["weights"]), np.float64), got[0]["bias"]) if got else (np.zeros(BUCKETS), 0.0)
    return {"patterns": patterns, "posterior": post, "votes": theta, "good": good, "weights": w, "bias": b}


def _fitting(patterns: np.ndarray, post: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = list(_rows_of_features(batches))  # one function, so that one worker does it all
        cells = lambda i: [x for b in sample for x in b.column(i).to_pylist()]
        sizes = np.array([len(x) // 2 for x in cells(1)], np.int64)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        bucket, value = np.frombuffer(b"".join(cells(1)), np.uint16), np.frombuffer(b"".join(cells(2)), np.float32)
        target = post[np.searchsorted(patterns, np.array(cells(0), np.int64))] if len(sizes) else np.empty(0)
        w, b = fit(row, bucket, value, target)
        del sample, row, bucket, value
        give_back()
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([float(b)])})

    return run


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """keep columns, n_words, label_posterior, score and kept for every row."""
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("patterns", "posterior", "weights", "bias")})
    given = docs.select(F.struct(*keep).alias("keep"), "text") if keep else docs.select(F.struct(F.lit(0).alias("none")).alias("keep"), "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text", 1 << 20):
            data, off = text_buffer(part.column(1))
            stats, words = statistics(data, off)
            r, b, v = features(data, off, stats, words)
            z = np.bincount(r, v * m["weights"][b], minlength=part.num_rows) + m["bias"]
            s = np.where(words["words"] > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)
            p = votes(stats)
            at = np.minimum(np.searchsorted(m["patterns"], p), len(m["patterns"]) - 1)
            post = np.where(m["patterns"][at] == p, m["posterior"][at], 0.5)
            yield pa.RecordBatch.from_pydict({
                "keep": part.column(0), "n_words": pa.array(words["words"].astype(np.int64)),
                "label_posterior": pa.array(post), "score": pa.array(s), "kept": pa.array(s >= KEEP_FROM),
            })

    kind = given.schema["keep"].dataType.simpleString()
    out = given.mapInArrow(scored, f"keep {kind}, n_words long, label_posterior double, score double, kept boolean")
    return out.select("keep.*", "n_words", "label_posterior", "score", "kept") if keep else out.drop("keep")


def classify(docs: DataFrame, *keep: str) -> DataFrame:
    """Train on docs(doc_id, text) and score every row."""
    return score(docs, train(docs), *keep)
