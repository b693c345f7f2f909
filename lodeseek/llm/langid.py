"""Language identification: multinomial logistic regression on hashed TF-IDF character n-grams.

Document frequencies are counted over every labelled document. The model is fitted on a bounded sample for each
language with follow-the-regularised-leader steps under elastic-net penalties, so most weights are exactly 0; a
temperature, found on labelled rows that were not used for the fit, scales its scores to probabilities.

Defined results: null texts and texts without a letter are `und` with score 0; rows without a label never train;
with no labelled row at all, as in an empty table, every text is `und`; of equally likely languages the first by name
is told; a very long text is one row of counts, taken whole; repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, give_back, pack, sample_share, slices, splitmix, summed

#: Labelled documents of each language, about, on which weights are fitted; a quarter as many set the temperature.
FIT_PER_LANGUAGE = 800
BITS = 15
ORDERS = (2, 3)
UNKNOWN = "und"
#: Documents with a lower score are rejected by the filter.
REJECT_BELOW = 0.5
#: Bytes of text that are cut into n-grams at once: some 60 bytes of arrays for each character.
SLICE = 1 << 19

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of letters and word ends, and how many letters each row has. Runs of other characters count as one blank."""
    parts = [f" {t.lower()} " if t else " " for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[1:] |= row[1:] != row[:-1]
    points, row, letter = np.where(letter, points, 32)[keep].astype(U64), row[keep], letter[keep]
    rows, buckets = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        same = row[:m] == row[n - 1 :]
        h = np.full(m, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, U64)
        for j in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + points[j : j + m]
        h = (h * U64(0x94D049BB133111EB)) ^ (h >> U64(29))
        rows.append(row[:m][same])
        buckets.append((((h * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BITS))[same]).astype(np.int64))
    count = np.bincount(row[letter], minlength=len(parts))
    e = np.empty(0, np.int64)
    return np.concatenate(rows) if rows else e, np.concatenate(buckets) if buckets else e, count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of each bucket, then the number of documents."""
    df = np.zeros((1 << BITS) + 1, np.int64)
    for part in slices(batches, "text", SLICE):
        row, bucket, letters = grams(part.column(0).to_pylist())
        seen = np.zeros(1 << BITS, bool)
        order = np.argsort(row, kind="stable")
        bucket, cut = bucket[order], np.searchsorted(row[order], np.arange(part.num_rows + 1))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            seen[bucket[i:j]] = True
            df[:-1] += seen
            seen[bucket[i:j]] = False
        df[-1] += int((letters > 0).sum())
    yield pa.RecordBatch.from_pydict({"blob": pa.array([pack(df)], pa.binary())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        row, bucket, _ = grams(part.column(0).to_pylist())
        keys, n = np.unique(row.astype(np.int64) << BITS | bucket, return_counts=True)
        cut = np.searchsorted(keys, np.arange(part.num_rows + 1) << BITS)
        b, n = (keys & (1 << BITS) - 1).astype(np.uint16), n.astype(np.float32)
        yield pa.RecordBatch.from_pydict({
            "lang": part.column(1), "part": part.column(2),
            "buckets": pa.array([b[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            "counts": pa.array([n[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        })


class Ftrl:
    """Follow the regularised leader, proximal, for a softmax over sparse rows."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The scale under which the labels are likeliest, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(_softmax(scores / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column) -> Column:
    """Rows that may not be learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE, epochs: int = 3) -> dict:
    """Fit on labelled(text, lang); rows with a null in either are left out."""
    labelled = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(per)
    if not names:
        return {"names": [], "table": None}
    total = summed(labelled.select("text").mapInArrow(_frequencies, "blob binary"), (1 << BITS) + 1)
    idf = np.log((1 + total[-1]) / (1 + total[:-1])) + 1
    share = F.element_at(F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, 1.25 * per_language / per[k])))]), F.col("lang"))
    pick = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1e6)
    sample = labelled.where(pick < share).withColumn("part", F.when(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(5)) == 0, 1).otherwise(0))
    # the share makes the sample about 1.25 * per_language a language; where chance or repeated texts make it larger, the least hashes stay
    bounded = sample.orderBy(F.xxhash64("text", F.lit(3)), "lang", "text").limit(5 * per_language * len(names))
    # the sample is fitted where it lies: only the model's table comes to the driver
    got = bounded.coalesce(1).mapInArrow(_fitting(names, idf, epochs), "weights binary, temperature double, nonzero double").collect()
    if not got:  # Spark saw that there is nothing to fit
        got = [dict(zip(("weights", "temperature", "nonzero"), _fit([], names, idf, epochs), strict=True))]
    table = np.frombuffer(bytes(got[0]["weights"]), np.float32).reshape(-1, len(names))
    return {"names": names, "table": table, "temperature": got[0]["temperature"], "nonzero": got[0]["nonzero"]}


def _fitting(names: list[str], idf: np.ndarray, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one function, so that one worker does it all
        weights, t, nonzero = _fit(_counted(batches), names, idf, epochs)
        give_back()
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights], pa.binary()), "temperature": pa.array([t]), "nonzero": pa.array([nonzero])})

    return run


def _fit(sample: Iterable[pa.RecordBatch], names: list[str], idf: np.ndarray, epochs: int) -> tuple[bytes, float, float]:
    """Weights of buckets by language, over the temperature, in four bytes each; the temperature; and the share of weights that are not 0."""
    langs, parts, ats, xs, sizes = [], [], [], [], []
    for b in sample:
        # a batch's rows end to end in two arrays: no small objects that keep a worker's memory
        n = np.diff(np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset :][: b.num_rows + 1]) // 2
        a = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16)
        c = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float32)
        row = np.repeat(np.arange(len(n)), n)
        total = np.maximum(1.0, np.bincount(row, c, minlength=len(n)))
        ats.append(a)
        xs.append((c / total[row] * idf[a]).astype(np.float32))
        sizes.append(n)
        langs += b.column(0).to_pylist()
        parts += b.column(1).to_pylist()
    cat = lambda v, kind: np.concatenate(v) if v else np.empty(0, kind)
    flat_at, flat_x, ends = cat(ats, np.uint16), cat(xs, np.float32), np.concatenate(([0], np.cumsum(cat(sizes, np.int64)))).astype(np.int64)
    del ats, xs
    at = [flat_at[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    x = [flat_x[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    place = {k: i for i, k in enumerate(names)}
    y, part = np.array([place[k] for k in langs], np.int64), np.array(parts, np.int64)
    model, rng = Ftrl(1 << BITS, len(names)), np.random.default_rng(11)
    # the order must not depend on how tasks ended
    order = sorted(np.flatnonzero(part == 0), key=lambda i: (y[i], len(at[i]), hashlib.sha1(at[i]).digest(), hashlib.sha1(x[i]).digest()))
    for _ in range(epochs):
        for i in rng.permutation(order).astype(np.int64) if len(order) else []:
            if len(at[i]):
                model.step(at[i], x[i], int(y[i]))
    w = model.weights()
    check = [i for i in np.flatnonzero(part == 1) if len(at[i])] or [i for i in order if len(at[i])]
    t = temperature(np.array([x[i] @ w[at[i]] for i in check]).reshape(-1, len(names)), y[check])
    return (w * idf[:, None] / t).astype(np.float32).tobytes(), t, float((w != 0).mean())


def predict(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """keep columns, lang_pred and score for every row; only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.struct(*keep).alias("keep"), "text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text", SLICE):
            n, names = part.num_rows, m["names"]
            row, bucket, letters = grams(part.column(1).to_pylist())
            if names:
                count = np.maximum(1, np.bincount(row, minlength=n))
                s = np.stack([np.bincount(row, m["table"][:, c][bucket], minlength=n) / count for c in range(len(names))], 1)
                p = _softmax(s)
                best, top = p.argmax(1), p.max(1)
            known = (letters > 0) & bool(names)
            yield pa.RecordBatch.from_pydict({
                "keep": part.column(0),
                "lang_pred": pa.array([names[best[i]] if known[i] else UNKNOWN for i in range(n)], pa.string()),
                "score": pa.array(np.where(known, top, 0.0) if names else np.zeros(n)),
            })

    kind = given.schema["keep"].dataType.simpleString()
    return given.mapInArrow(predicted, f"keep {kind}, lang_pred string, score double").select("keep.*", "lang_pred", "score")


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """Learn from the rows of docs(doc_id, text, lang) that are not held out, then predict every row."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id")))), *keep)
