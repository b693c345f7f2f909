"""Regular expressions by a finite automaton, in Arrow batches: for patterns that a backtracking engine cannot be trusted with.

Arrow's regular expressions run on RE2, which never recurses and takes time linear in the text. A batch's matches are
marked in its texts by one replacement; lines, columns and matched texts of all hits are then read off the marked bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are marked at once; a longer text goes alone.
SLICE = 8 << 20
#: Characters that Unicode reserves from exchange; two that none of a slice's texts holds are its marks.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]

# White space, decimal digits and word characters of Unicode in RE2's terms, whose own are ASCII.
_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NOT_WHITE = r"\x00-\x08\x0e-\x1f!-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}"
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}"
_CLASSES = {"d": r"\p{Nd}", "D": r"\P{Nd}", "s": _WHITE, "S": _NOT_WHITE, "w": _WORD}


def in_automaton_terms(pattern: str) -> str | None:
    """A valid pattern of the search dialect in RE2's terms; None where RE2 has no such thing (word boundaries beyond ASCII, set operations, comments)."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e in "bB" or (in_class and e == "W"):
                return None
            if m := re.match(r"\\[uUx](?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{2}))", pattern[i:]):
                out.append(f"\\x{{{(m[1] or m[2]).lstrip('0') or '0'}}}")
                i += len(m[0])
                continue
            if m := re.match(r"\\([pP])(?:\{(\^?)([A-Za-z_]+)\}|([A-Z]))", pattern[i:]):
                out.append(m[0])
                i += len(m[0])
                continue
            if e in "pP":
                return None
            known = _CLASSES.get(e)
            out.append((known if in_class else f"[{known}]") if known else f"[^{_WORD}]" if e == "W" else pattern[i : i + 2])
            i += 2
        elif in_class:
            if m := re.match(r"\[:\^?\w+:\]", pattern[i:]):
                out.append(m[0])
                i += len(m[0])
                continue
            if c == "[" or pattern[i : i + 2] in ("&&", "--", "~~"):
                return None
            in_class = c != "]"
            out.append(c)
            i += 1
        elif c == "[":
            m = re.match(r"\[\^?\]?", pattern[i:])
            out.append(m[0])
            i, in_class = i + len(m[0]), True
        elif c == "(" and (m := re.match(r"\(\?([a-zA-Z-]*)([:)])", pattern[i:])):
            flags = m[1].replace("u", "") if "-" not in m[1] else m[1]
            if set(flags) - set("ims-"):
                return None
            out.append(f"(?{flags}{m[2]}" if flags or m[2] == ":" else "")
            i += len(m[0])
        elif c == "(" and (m := re.match(r"\(\?P?<(\w+)>", pattern[i:])):
            out.append("(")
            i += len(m[0])
        else:
            out.append(c)
            i += 1
    found = "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), found)
    except pa.ArrowInvalid:
        return None
    return found


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)), at - at[0]


def _marked(texts: pa.Array, pattern: str) -> tuple[pa.Array, str, str]:
    free = [m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()]
    if len(free) < 2:
        raise ValueError("a text holds all of the characters that are reserved for marks")
    return pc.replace_substring_regex(texts, pattern=pattern, replacement=f"{free[0]}\\0{free[1]}"), free[0], free[1]


def _found(texts: pa.Array, pattern: str, kind: pa.DataType) -> pa.Array:
    marked, first, last = _marked(texts, pattern)
    raw, off = _bytes(marked)
    lead = np.flatnonzero(raw[:-2] == first.encode()[0]) if len(raw) > 2 else np.empty(0, np.int64)
    lead = lead[raw[lead + 1] == first.encode()[1]]
    opens, closes = (lead[raw[lead + 2] == m.encode()[2]] for m in (first, last))
    marks = np.sort(np.concatenate((opens, closes)))
    ends = np.flatnonzero(raw == 10)
    row = np.searchsorted(off, opens, side="right") - 1

    def place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = off[row]
        k = np.searchsorted(ends, at)
        line = k - np.searchsorted(ends, start)
        begin = np.where(line > 0, ends[np.maximum(k - 1, 0)] + 1 if len(ends) else start, start)
        return line + 1, at - begin - 3 * (np.searchsorted(marks, at) - np.searchsorted(marks, begin))

    line1, col1 = place(opens)
    line2, col2 = place(closes)
    size = closes - opens - 3
    ends_of = np.concatenate(([0], np.cumsum(size)))
    held = raw[np.repeat(opens + 3 - ends_of[:-1], size) + np.arange(ends_of[-1])]
    text = pa.Array.from_buffers(pa.large_string(), len(opens), [None, pa.py_buffer(ends_of.astype(np.int64)), pa.py_buffer(held)]).cast(pa.string())
    fields = [pa.array(x.astype(np.int32)) for x in (line1, col1, line2, col2)]
    rows = pa.StructArray.from_arrays([*fields, text], fields=list(kind.value_type))
    counts = np.bincount(row, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), rows, type=kind)


def _sliced(texts: pa.Array) -> Iterator[pa.Array]:
    _, off = _bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def hits(texts: pa.Array, pattern: str) -> pa.Array:
    """All hits of each text, as lists of (line_start, col_start, line_end, col_end, matched_text); none of null texts."""
    names = ("line_start", "col_start", "line_end", "col_end")
    kind = pa.list_(pa.struct([*[pa.field(n, pa.int32()) for n in names], pa.field("matched_text", pa.string())]))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # a null text has no hits, an empty one may have an empty hit
    given = texts.is_valid()
    parts = [_found(s, pattern, kind) for s in _sliced(texts.filter(given))]
    found = pa.concat_arrays(parts) if parts else pa.array([], kind)
    where = pa.array(np.where(given.to_numpy(zero_copy_only=False), np.cumsum(given.to_numpy(zero_copy_only=False)) - 1, len(found)))
    return pa.concat_arrays([found, pa.array([[]], kind)]).take(where)


def hits_column(text: Column, pattern: str, schema: str) -> Column:
    @F.arrow_udf(schema)
    def found(texts: pa.Array) -> pa.Array:
        return hits(texts, pattern)

    return found(text)
