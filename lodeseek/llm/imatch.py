"""Document fingerprints by I-Match with randomised lexicons.

Terms are kept whose document frequency lies in a band: neither so common that all documents share them, nor rarer than
its lower end, which is 2 documents at least. Frequencies are exact: hashes of terms are counted in a shuffle, slices of
documents summed up before it. The terms of the band, not more than a document's terms over its lower end however many
documents there are, are then told by a bitmap of at most 2 ** MOST_BITS bits in TESTS places each; another term passes
by chance, the same one everywhere, for about one in a thousand at two million terms of the band. A fingerprint holds the hash of all distinct kept terms, and, for each of several sampling
rates, hashes of the terms that lie in each of a number of random lexicon subsets. The terms' own hashes are distinct
and sorted, and a subset's hash is their sum after mixing, which does not depend on order either.

Of two fingerprints, the share of equal subset hashes falls with the terms that the documents do not share:
log P(equal) / log P(both empty) at a sampling rate estimates the unshared part of their terms. Likeness is 1 less it.

Defined results: a null text is an empty one; a document with fewer than MIN_TERMS terms in the band keeps all its terms;
very long texts are taken whole, and an empty table gives an empty result;
without any term the fingerprint is empty and likeness 1 to an equal one, else 0; equal doc_ids follow one another by
the hash of their texts, null ids come last; the only document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, U64, Scratch, slices, span_hashes, splitmix, text_buffer, word_spans

#: The band of document frequencies: at least LEAST documents and the share RAREST of all, at most the share COMMONEST.
LEAST, RAREST, COMMONEST = 2, 2.0**-18, 0.10
#: Bits of the bitmap for each term of the band, the most that it has, as a power of two, and the places of a term.
TERM_BITS, MOST_BITS, TESTS = 32, 26, 3
MIN_TERMS = 3
#: Subsets at each sampling rate; rates are 4 ** -1 to 4 ** -LEVELS.
SUBSETS, LEVELS = 16, 6
_SALTS = splitmix(np.arange(1, SUBSETS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct terms, sorted."""
    data = LOWER[data]
    s, e, first = word_spans(data, offsets, NOT_ALNUM)
    h, row = span_hashes(data, s, e), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


class Lexicon:
    """The terms of the band, as a bitmap."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [splitmix(h + U64(0xD1B54A32D192ED03 * k & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - self.bits) for k in range(1, TESTS + 1)]

    def put(self, h: np.ndarray) -> None:
        for p in self.places(h):
            np.bitwise_or.at(self.words, (p >> U64(6)).astype(np.int64), U64(1) << (p & U64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h):
            out &= (self.words[(p >> U64(6)).astype(np.int64)] >> (p & U64(63))) & U64(1) == 1
        return out


def empty_lexicon(terms: int) -> Lexicon:
    bits = min(max(10, (TERM_BITS * terms).bit_length()), MOST_BITS)
    return Lexicon(bits, np.zeros(1 << (bits - 6), U64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 16 << 20):
        _, h = terms(*text_buffer(part.column(0)))
        h, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_pydict({"term": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def frequencies(docs: DataFrame) -> DataFrame:
    """term (its hash) and n, the number of documents that hold it, over all of docs(text)."""
    return docs.select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame) -> Lexicon:
    """The terms of docs(text) whose frequency lies in the band."""
    rows = docs.select("text").count()
    with Scratch(docs.sparkSession) as scratch:
        band = scratch.written(frequencies(docs).where((F.col("n") >= max(LEAST, RAREST * rows)) & (F.col("n") <= COMMONEST * rows)).select("term"), "band")
        found = empty_lexicon(band.count())

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = np.concatenate(found.places(b.column(0).to_numpy().view(U64)))
                yield pa.RecordBatch.from_pydict({"word": pa.array((p >> U64(6)).astype(np.int64)), "held": pa.array((U64(1) << (p & U64(63))).view(np.int64))})

        # at most 2 ** (MOST_BITS - 6) words, whatever the number of terms
        words = band.mapInArrow(places, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
        found.words[words["word"].to_numpy()] = words["held"].to_numpy().view(U64)
    return found


def fingerprints(texts: list[str], band: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    """For each text the hash of all its terms in the band (without one, of all its terms), and the 16-bit hashes of its subsets (LEVELS x SUBSETS), 0 where a subset is empty."""
    n = len(texts)
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    row, h = terms(data, offsets)
    kept = band.has(h) if band is not None else np.ones(len(h), bool)
    enough = np.bincount(row[kept], minlength=n) >= MIN_TERMS
    kept |= ~enough[row]
    row, h = row[kept], h[kept]
    whole = np.zeros(n, U64)
    np.add.at(whole, row, splitmix(h))
    out = np.zeros((n, LEVELS, SUBSETS), U64)
    for j in range(SUBSETS):
        u = splitmix(h ^ _SALTS[j])
        r, v = row, u
        for level in range(LEVELS):
            inside = np.flatnonzero(v < U64((1 << 64) >> 2 * (level + 1)))
            r, v = r[inside], v[inside]
            np.add.at(out[:, level, j], r, splitmix(v) | U64(1 << 63))
    flat = out.reshape(n, -1)
    short = (splitmix(flat) >> U64(48)).astype(np.uint16)
    short[(short == 0) & (flat != 0)] = 1
    short[flat == 0] = 0
    return splitmix(whole), short


def written_out(whole: np.ndarray, short: np.ndarray) -> list[str]:
    """Fingerprints as text: 16 hexadecimal digits, then 4 for each subset."""
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(whole.astype(">u8"), short.astype(">u2"), strict=True)]


def likeness(a_whole: np.ndarray, a: np.ndarray, b_whole: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common terms of each pair of fingerprints, 0 to 1."""
    a3, b3 = a.reshape(len(a), LEVELS, SUBSETS), b.reshape(len(b), LEVELS, SUBSETS)
    equal, empty = (a3 == b3).sum(2), ((a3 == 0) & (b3 == 0)).sum(2)
    # levels at which some but not all subsets are empty tell most
    use = (empty >= 1) & (empty < SUBSETS)
    fallback = ~use.any(1)
    level = np.where((empty < 1).any(1), (empty < 1).sum(1) - 1, 0)
    use[fallback, np.minimum(level, LEVELS - 1)[fallback]] = True
    log = lambda k: -np.log((k + 0.5) / (SUBSETS + 1))
    apart = (np.where(use, log(equal), 0).sum(1) - np.where(use, log(np.full_like(equal, SUBSETS)), 0).sum(1)) / np.maximum(
        1e-9, np.where(use, log(empty), 0).sum(1) - np.where(use, log(np.full_like(empty, SUBSETS)), 0).sum(1)
    )
    out = np.clip(1 - apart, 0, 1)
    none = (a == 0).all(1) & (b == 0).all(1)
    out[none] = 0.0
    out[a_whole == b_whole] = 1.0
    return out


def edited(text: str, after: str) -> str:
    """text with its last third replaced by as much of the start of after."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _splits(docs: DataFrame, parts: int) -> np.ndarray:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    qs = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx(key, qs, 10_000)).first()[0] if qs else []
    return np.unique(np.array(got or [], np.int64))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs(doc_id, text) dealt to runs of doc_ids, each sorted in descending order and followed by the first row of the next run, marked as ahead.

    The text is shuffled once; only the split points and each run's first id, some for each task, pass through the driver."""
    splits = _splits(docs, parts)
    top = len(splits)

    @F.pandas_udf("int")
    def run_of(key: pd.Series) -> pd.Series:
        return pd.Series((top - np.searchsorted(splits, key.to_numpy(), side="right")).astype(np.int32))

    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key")).withColumn("run", run_of("key"))
    heads = {r["run"]: r["key"] for r in keyed.groupBy("run").agg(F.max("key").alias("key")).collect()}
    runs = sorted(heads)
    before = {heads[r]: runs[i - 1] for i, r in enumerate(runs)}
    # a row for each run but the first
    ahead = docs.sparkSession.createDataFrame([(int(k), int(v)) for k, v in before.items()], "head long, before int")
    met = keyed.join(F.broadcast(ahead), F.col("key") == F.col("head"), "left")
    own, lead = F.struct(F.col("run").alias("run"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("run"), F.lit(1).alias("ahead"))
    rows = met.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, lead))))
    rows = rows.select("doc_id", "text", "key", F.col("to.run").alias("run"), F.col("to.ahead").alias("ahead"), F.xxhash64("text").alias("h"))
    # each run is a task of its own
    return rows.repartitionById(parts, "run").sortWithinPartitions("run", "ahead", F.desc("key"), "h").select("doc_id", "text", "run", "ahead")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs(doc_id, text), of its edited text, and their likeness to it and to the next document."""
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs))  # 2 ** MOST_BITS bits at most
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = band.value

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            """Of rows but the last, which is only the next one of the row before it."""
            changed = [edited(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
            whole, short = fingerprints(texts, lex)
            whole2, short2 = fingerprints(changed, lex)
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids[:-1], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                "fingerprint": pa.array(written_out(whole[:-1], short[:-1])), "edited_fingerprint": pa.array(written_out(whole2, short2)),
                "near_edited": pa.array(likeness(whole[:-1], short[:-1], whole2, short2)), "near_next": pa.array(likeness(whole[:-1], short[:-1], whole[1:], short[1:])),
            })

        held: tuple | None = None  # the last row, which awaits its next
        for part in slices(batches, "text"):
            cols = [part.column(i).to_pylist() for i in range(4)]
            ids, texts = ([held[0]], [held[1]]) if held else ([], [])
            run = held[2] if held else None
            for i, t, r, ahead in zip(*cols, strict=True):
                if run is not None and r != run:
                    ids, texts = [], []  # the run before is over
                if ahead and not ids:
                    run = r
                    continue  # further rows ahead of a run that is over
                ids.append(i)
                texts.append(t or "")
                run = r
                if ahead:
                    yield done(ids, texts)
                    ids, texts = [], []
            if len(ids) > 1:
                yield done(ids, texts)
            held = (ids[-1], texts[-1], run) if ids else None

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs.select("doc_id", "text"), parts).mapInArrow(rows, out)
