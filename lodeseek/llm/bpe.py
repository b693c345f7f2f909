"""Byte-level BPE with padded numpy matrices.

The pattern cuts texts into pieces; each distinct piece of a slice is encoded once. Pieces of like length stand in one
matrix, a row for each, padded on the right. Every round each row merges its leftmost pair of least rank; pairs are
found in a hash table from two tokens to the token of their joined bytes. Rows without a pair leave the matrix. A piece
that is a token itself is taken whole, as the merges might not reach it. A piece of more than WIDE bytes is a row of its
own, and a round merges its least pair wherever it stands, left to right, as the next rounds would do, up to the first
place where the merged token makes a pair of lower rank, which then comes first. Its rounds are then about as many as
the ranks that occur in it, instead of one for each merge.

Defined results: a null text is an empty one, with no tokens and the digests of no bytes; repeated rows each get their
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of the widest matrix.
WIDE = 192
NONE = np.int64(1 << 40)


class Ranks:
    """A rank file, the table of its pairs, and the bytes of its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        size = max(self.rank.values()) + 1
        self.size = size
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        tokens = [b""] * size
        for t, r in self.rank.items():
            tokens[r] = t
        self.tokens = tokens
        self.ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        keys, values = [], []
        get = self.rank.get
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                if (left := get(t[:i])) is not None and (right := get(t[i:])) is not None:
                    keys.append(left * size + right)
                    values.append(r)
        self._table(np.array(keys, np.int64), np.array(values, np.int64))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing; every key lies at most self.probes places on."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at, left, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[at[left]] < 0
            order = left[free]
            _, first = np.unique(at[order], return_index=True)
            put = order[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token of each joined pair, NONE where there is none or either side is padding (-1)."""
        keys = left * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        flat_keys, flat_out, flat_at = keys.reshape(-1), out.reshape(-1), at.reshape(-1)
        open_ = np.flatnonzero(((found != keys) & (found >= 0)).reshape(-1))
        while len(open_):
            flat_at[open_] = (flat_at[open_] + 1) & ((1 << self.bits) - 1)
            f, k = self.keys[flat_at[open_]], flat_keys[open_]
            hit = f == k
            flat_out[open_[hit]] = self.values[flat_at[open_[hit]]]
            open_ = open_[~hit & (f >= 0)]
        return flat_out.reshape(out.shape)


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def _merge_matrix(ids: np.ndarray, r: Ranks) -> list[np.ndarray]:
    """ids: rows of tokens, -1 beyond each row's end. Returns the merged rows."""
    n = len(ids)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * n
    where = np.arange(n)
    joined = r.lookup(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((n, 0), NONE)
    while True:
        if joined.shape[1] == 0:
            done = np.ones(len(ids), bool)
        else:
            at = joined.argmin(1)  # the first of equal ones: the leftmost
            rows = np.arange(len(ids))
            least = joined[rows, at]
            done = least >= NONE
        if done.any():
            ended = ids[done]
            lengths = (ended >= 0).sum(1)
            for i, w in enumerate(where[done].tolist()):
                out[w] = ended[i, : lengths[i]]
            if done.all():
                return out
            keep = ~done
            ids, joined, where, at, least = ids[keep], joined[keep], where[keep], at[keep], least[keep]
            rows = np.arange(len(ids))
        # close the gap right of the merged place
        width = ids.shape[1]
        cols = np.arange(width - 1)
        move = cols[None, :] > at[:, None]
        new = np.where(move, ids[:, 1:], ids[:, :-1])
        new[rows, at] = least
        pairs = np.where(move[:, :-1], joined[:, 1:], joined[:, :-1]) if width > 2 else joined[:, :0]
        if width > 2:
            has = at < width - 2
            if has.any():
                pairs[rows[has], at[has]] = r.lookup(new[rows[has], at[has]], new[rows[has], at[has] + 1])
            has = at > 0
            if has.any():
                pairs[rows[has], at[has] - 1] = r.lookup(new[rows[has], at[has] - 1], new[rows[has], at[has]])
        used = max(1, int((new >= 0).sum(1).max()))
        if used < width - 1:
            new, pairs = new[:, :used], pairs[:, : max(0, used - 1)]
        ids, joined = new, pairs


def _merge_row(ids: np.ndarray, r: Ranks) -> np.ndarray:
    """The merged tokens of one long row."""
    joined = r.lookup(ids[:-1], ids[1:])
    while len(joined) and (least := joined.min()) < NONE:
        at = np.flatnonzero(joined == least)
        # of places side by side every second one, from the left, as each merge takes the next place's token
        starts = np.concatenate(([True], np.diff(at) != 1))
        at = at[(at - np.maximum.accumulate(np.where(starts, at, 0))) % 2 == 0]
        left = np.where(at > 0, ids[at - 1], -1)
        left[1:][np.diff(at) == 2] = least
        right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        this = np.full(len(at), least)
        lower = (r.lookup(left, this) < least) | (r.lookup(this, right) < least)
        if lower.any():
            at = at[: int(lower.argmax()) + 1]
        ids[at] = least
        ids = np.delete(ids, at + 1)
        joined = np.delete(joined, at)
        now = at - np.arange(len(at))
        for places in (now[now > 0] - 1, now[now < len(joined)]):
            joined[places] = r.lookup(ids[places], ids[places + 1])
    return ids


def encode_pieces(pieces: list[str], r: Ranks) -> list[np.ndarray]:
    """Tokens of each piece."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(raw)
    groups: dict[int, list[int]] = {}
    get = r.rank.get
    for i, p in enumerate(raw):
        if (t := get(p)) is not None:
            out[i] = np.array([t], np.int64)
        elif len(p) > WIDE:
            out[i] = _merge_row(r.byte[np.frombuffer(p, np.uint8)], r)
        else:
            n = len(p)
            groups.setdefault(n if n <= 16 else 16 << ((n - 1) // 16).bit_length(), []).append(i)
    for width, members in groups.items():
        step = max(1, (1 << 18) // width)
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in some), np.uint8).reshape(len(some), width)
            ids = r.byte[flat]
            lengths = np.fromiter((len(raw[i]) for i in some), np.int64, len(some))
            ids[np.arange(width)[None, :] >= lengths[:, None]] = -1
            for i, tokens in zip(some, _merge_matrix(ids, r), strict=True):
                out[i] = tokens
    return out


def encode(texts: list[str | None], r: Ranks, cut: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, end to end, and n + 1 offsets."""
    known: dict[str, int] = {}
    put = known.setdefault
    order, sizes = [], []
    for t in texts:
        found = [put(p, len(known)) for p in cut.findall(t)] if t else []
        order.append(np.array(found, np.int64))
        sizes.append(len(found))
    tokens = encode_pieces(list(known), r)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.concatenate(([0], np.cumsum(length)))
    flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
    piece = np.concatenate(order) if order else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(length[piece])))
    ids = flat[np.repeat(start[piece] - ends[:-1], length[piece]) + np.arange(ends[-1])]
    return ids, ends[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]


def decode(ids: np.ndarray, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens, end to end, and the end of each token."""
    length = r.ends[ids + 1] - r.ends[ids]
    ends = np.concatenate(([0], np.cumsum(length)))
    return r.joined[np.repeat(r.ends[ids] - ends[:-1], length) + np.arange(ends[-1])], ends


def encoded(docs: DataFrame, rank_file: str, pattern: str, *keep: str, with_ids: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 and, on demand, the ids of every row of docs(text)."""
    given = docs.select(F.struct(*keep).alias("keep"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, cut = ranks(rank_file), regex.compile(pattern)
        for part in slices(batches, "text", 1 << 18):
            ids, off = encode(part.column(1).to_pylist(), r, cut)
            back, ends = decode(ids, r)
            small = ids.astype("<u4")
            spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            out = {
                "keep": part.column(0), "n_tokens": pa.array(np.diff(off)),
                "ids_sha256": pa.array([hashlib.sha256(small[i:j]).hexdigest() for i, j in spans]),
                "decoded_sha256": pa.array([hashlib.sha256(back[ends[i] : ends[j]]).hexdigest() for i, j in spans]),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    kind = given.schema["keep"].dataType.simpleString()
    schema = f"keep {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return given.mapInArrow(run, schema).select("keep.*", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)
