"""Alignment of two tokenizers over the same bytes, with counts over the whole corpus.

Both tokenizers encode a space and the text. Where a token of each ends at the same byte, the two are linked; these
ends cut the tokens into groups. A document becomes its distinct linked id pairs with their multiplicities: its
postings. Postings are counted for each pair of ids (copies of a pair meet on the map side), the counts of each B id
meet in one place for their maximum, and then postings and counts meet again, as two sorted streams that may spill,
to tell what each document gets; documents sum that up.

Pairs follow a steep law, as words do. Those that make up more than 1 in HOT of all postings, HOT at most whatever
the corpus, would each fill a task, and are a large part of all rows: their counts are broadcast instead, and their postings
are never shuffled. The shuffle holds the long tail, in which no pair is large.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens:
zeros, and '' for groups_sha256; repeated rows each get their row and count as often as they stand; null ids are kept;
an empty table gives an empty result; other columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, written

#: A pair with more than one posting in so many is broadcast; there are fewer of them.
HOT = 2048


# ---------------------------------------------------------------- tokenizers


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 letters stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces:
    """The bytes of each id, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.joined = np.frombuffer(b"".join(pieces), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.joined[np.repeat(self.start[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel:
    """A byte-level BPE file of the tokenizers library. Where the order of its merges is that of its ids, as ranks demand, tiktoken encodes."""

    def __init__(self, path: str, pattern: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, vocab = _byte_letters(), data["model"]["vocab"]
        special = {t["content"] for t in data.get("added_tokens", [])}
        pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in data.get("added_tokens", []))]) + 1)
        for t, i in vocab.items():
            pieces[i] = t.encode() if t in special else bytes(letters[c] for c in t)
        self.pieces = Pieces(pieces)
        self.slow = tokenizers.Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        self.fast = None
        if made == sorted(set(made)) and len(made) + 256 == len(vocab) - len(special & set(vocab)):
            import tiktoken

            ranks = {pieces[i]: i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode_ordinary(text), np.int64)
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # its regex engine gives up (a panic) on runs that the other one takes
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class Sentence:
    """A sentencepiece model; it puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        name = self.model.id_to_piece
        self.pieces = Pieces([bytes([int(name(i)[1:-1], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(n)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> ByteLevel:
    return ByteLevel(path, pattern)


@lru_cache(maxsize=2)
def sentence(path: str) -> Sentence:
    return Sentence(path)


# ---------------------------------------------------------------- one slice of texts


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1, left-aligned, with room for a mark behind, and how many there are."""
    width = len(str(max(size - 1, 0)))
    text = np.zeros((size, width + 1), np.uint8)
    count = np.ones(size, np.int64)
    for k in range(1, width):
        count[10**k :] += 1
    for i in range(width):
        has = count > i
        text[has, i] = 48 + (np.arange(size)[has] // 10 ** (count[has] - 1 - i)) % 10
    return text, count


@lru_cache(maxsize=2)
def _written_ids(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _digits(size)


def _spelt(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, doc_a: np.ndarray, docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;...` of all documents end to end, a `;` behind each group, and the end of each document."""
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    # a group's A ids stand after all B ids of earlier groups, its B ids after its own A ids
    per_a, per_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    before_b, until_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + until_a[group_b]
    ids, mark, doc = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8), np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    mark[at_a], mark[at_b] = np.where(end_a, 124, 44), np.where(end_b, 59, 44)
    doc[at_a] = doc_a
    doc[at_b] = doc_a[np.flatnonzero(end_a)][group_b]
    text, count = _written_ids(size)
    rows, n = text[ids], count[ids]
    rows[np.arange(len(ids)), n] = mark
    flat = rows[np.arange(rows.shape[1])[None, :] <= n[:, None]]
    return flat, np.cumsum(np.bincount(doc, weights=n + 1, minlength=docs).astype(np.int64))


def aligned(texts: list[str | None], a_side: ByteLevel, b_side: Sentence) -> dict[str, pa.Array]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and the postings (pairs, times) of each text."""
    n = len(texts)
    usable = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = a_side.encode([" " + texts[i] for i in usable]), b_side.encode([texts[i] for i in usable])
    good, kept_a, kept_b = [], [], []
    for i, x, y in zip(usable, ids_a, ids_b, strict=True):
        raw = np.frombuffer(b" " + texts[i].encode(), np.uint8)
        if len(x) and len(y) and np.array_equal(a_side.pieces.bytes_of(x), raw) and np.array_equal(b_side.pieces.bytes_of(y), raw):
            good.append(i)
            kept_a.append(x)
            kept_b.append(y)
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digest = [""] * n
    owner, pair, times = (np.empty(0, np.int64) for _ in range(3))
    if good:
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        size_a, size_b = np.array([len(x) for x in kept_a]), np.array([len(x) for x in kept_b])
        # documents stand end to end, so ends are places in the whole slice
        ends_a, ends_b = np.cumsum(a_side.pieces.length[a]), np.cumsum(b_side.pieces.length[b])
        seen_a, seen_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
        seen_a[ends_a], seen_b[ends_b] = True, True
        last_a, last_b = seen_b[ends_a], seen_a[ends_b]
        doc_a = np.repeat(np.arange(len(good)), size_a)
        links = np.bincount(doc_a[last_a], minlength=len(good))
        for name, values in (("n_a", size_a), ("n_b", size_b), ("n_groups", links), ("n_links", links)):
            counts[name][good] = values
        flat, ends = _spelt(a, b, last_a, last_b, doc_a, len(good), max(a_side.pieces.size, b_side.pieces.size))
        for i, lo, hi in zip(good, [0, *ends[:-1]], ends, strict=True):
            digest[i] = hashlib.sha256(flat[lo : hi - 1]).hexdigest()
        width = a_side.pieces.size
        keys, times = np.unique(doc_a[last_a] * (width * b_side.pieces.size) + b[last_b] * width + a[last_a], return_counts=True)
        owner, pair = np.divmod(keys, width * b_side.pieces.size)
        owner = np.array(good)[owner]
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    out: dict[str, pa.Array] = {c: pa.array(v) for c, v in counts.items()}
    out["groups_sha256"] = pa.array(digest)
    out["pairs"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(pair))
    out["times"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))
    return out


# ---------------------------------------------------------------- Spark


def alignments(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, *keep: str) -> DataFrame:
    """keep columns, what aligned() tells of every row of docs(text), and the size of the A vocabulary (pairs are b * size_a + a)."""
    given = docs.select(F.struct(*keep).alias("keep"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = byte_level(byte_file, pattern), sentence(piece_file)
        for part in slices(batches, "text", 2 << 20):
            place: dict[str | None, int] = {}
            copies = pa.array([place.setdefault(t, len(place)) for t in part.column(1).to_pylist()], pa.int64())
            told = aligned(list(place), a_side, b_side)
            out = {"keep": part.column(0)} | {c: v.take(copies) for c, v in told.items()}
            yield pa.RecordBatch.from_pydict(out | {"size_a": pa.array(np.full(part.num_rows, a_side.pieces.size))})

    kind = given.schema["keep"].dataType.simpleString()
    schema = f"keep {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, size_a long"
    return given.mapInArrow(run, schema).select("keep.*", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "size_a")


def counted(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs(doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
        told = scratch.written(alignments(rows, byte_file, piece_file, pattern, "uid", "doc_id"), "postings")
        each = told.select("uid", "size_a", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("uid", "size_a", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        sums = each.groupBy("pair", "size_a").agg(F.sum("times").alias("links"), F.count(F.lit(1)).alias("postings"))
        sums = scratch.written(sums.select("pair", F.floor(F.col("pair") / F.col("size_a")).alias("b"), "links", "postings"), "pairs")
        most = sums.groupBy("b").agg(F.max("links").alias("most"))
        total = sums.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
        known = scratch.written(sums.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"), (F.col("postings") * hot > total).alias("often")), "counts")
        each = each.select("uid", "pair", "times")
        # fewer than `hot` pairs can have more than a part of 1 in `hot` of all postings
        often = known.where("often").select("pair", "links", "best")
        rest = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(known.where("not often").drop("often"), "pair")
        gained = lambda met: met.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
        parts = gained(each.join(F.broadcast(often), "pair")).unionByName(gained(rest))
        per = parts.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = told.select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(per, "uid", "left").na.fill(0, ["n_best", "count_sum"])
        return written(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "aligned")
