"""Text encodings: detection, decoding and encoding, as plain functions and as columns."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import small_batches

AUTO = "Auto"

#: Encodings with their labels, aliases, and what they are taken for.
ENCODINGS = {
    "Utf8": ("UTF-8", ["UTF8", "UTF-8N"], ["UTF-16 LE", "UTF-16 BE"]),
    "Utf16Le": ("UTF-16 LE", ["UTF-16", "Unicode"], ["UTF-8", "Shift_JIS (CP932)"]),
    "Utf16Be": ("UTF-16 BE", ["UTF-16", "Unicode"], ["UTF-8", "Shift_JIS (CP932)"]),
    "ShiftJis": ("Shift_JIS (CP932)", ["CP932", "Windows-31J", "MS_Kanji"], ["EUC-JP", "JIS (ISO-2022-JP)"]),
    "EucJp": ("EUC-JP", ["EUC"], ["Shift_JIS (CP932)", "JIS (ISO-2022-JP)"]),
    "Iso2022Jp": ("JIS (ISO-2022-JP)", ["JIS"], ["Shift_JIS (CP932)", "EUC-JP"]),
    "Gbk": ("GBK / GB18030", ["GB18030", "CP936"], ["Big5", "Latin1 / Windows-1252"]),
    "Big5": ("Big5", ["CP950"], ["GBK / GB18030", "Latin1 / Windows-1252"]),
    "EucKr": ("EUC-KR", ["KS X 1001", "CP949"], ["Latin1 / Windows-1252", "UTF-8"]),
    "Windows1252": ("Latin1 / Windows-1252", ["Latin1", "ISO-8859-1"], ["UTF-8", "Shift_JIS (CP932)"]),
}
#: Python's names of them.
CODECS = {"Utf8": "utf-8", "Utf16Le": "utf-16-le", "Utf16Be": "utf-16-be", "ShiftJis": "cp932", "EucJp": "euc_jp", "Iso2022Jp": "iso2022_jp", "Gbk": "gb18030", "Big5": "big5", "EucKr": "cp949", "Windows1252": "cp1252"}
_BY_CODEC = {codecs.lookup(c).name: e for e, c in CODECS.items()} | {"ascii": "Utf8", "latin-1": "Windows1252", "iso8859-1": "Windows1252", "shift_jis": "ShiftJis", "gbk": "Gbk", "gb2312": "Gbk", "euc_kr": "EucKr", "big5hkscs": "Big5"}


class DecodeError(ValueError):
    """The bytes are not text in that encoding."""


@dataclass(frozen=True)
class Decoded:
    text: str
    encoding: str


def label(encoding: str) -> str:
    if encoding == AUTO:
        return "Auto detect"
    return ENCODINGS[encoding][0] if encoding in ENCODINGS else encoding.removeprefix("detected:")


def aliases(encoding: str) -> list[str]:
    return ENCODINGS.get(encoding, ("", [], []))[1]


def near_misses(encoding: str) -> list[str]:
    return ENCODINGS.get(encoding, ("", [], []))[2]


def detail(encoding: str, auto: bool = False) -> str:
    parts = [f"{'Auto detected' if auto else 'Encoding'}: {label(encoding)}"]
    if a := aliases(encoding):
        parts.append("Aliases: " + ", ".join(a))
    if n := near_misses(encoding):
        parts.append("Near matches: " + ", ".join(n))
    return " / ".join(parts)


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, x[0], ", ".join(x[1]), ", ".join(x[2])) for e, x in ENCODINGS.items()], "encoding string, label string, aliases string, near string")


def decode_as(raw: bytes, encoding: str) -> Decoded:
    """Strictly in one encoding; a byte-order mark at the start is dropped."""
    codec = CODECS.get(encoding) or encoding.removeprefix("detected:")
    try:
        text = raw.decode(codec)
    except (UnicodeDecodeError, LookupError) as e:
        raise DecodeError(str(e)) from None
    return Decoded(text.removeprefix("﻿"), encoding)


def by_mark(raw: bytes) -> Decoded | None:
    """By a byte-order mark; 32-bit marks are an error, also where they begin like a 16-bit one."""
    if raw.startswith((codecs.BOM_UTF32_BE, codecs.BOM_UTF32_LE)):
        raise DecodeError("UTF-32 is not supported")
    for mark, encoding in ((codecs.BOM_UTF8, "Utf8"), (codecs.BOM_UTF16_LE, "Utf16Le"), (codecs.BOM_UTF16_BE, "Utf16Be")):
        if raw.startswith(mark):
            return decode_as(raw, encoding)
    return None


def without_mark(raw: bytes) -> str | None:
    """UTF-16 by the zeros of the first 512 bytes: nearly all on one side of the pairs, hardly any on the other."""
    head = raw[:512]
    pairs = len(head) // 2
    if pairs < 4:
        return None
    even, odd = head[::2].count(0), head[1::2].count(0)
    if odd * 5 >= pairs * 4 and even * 5 <= pairs:
        return "Utf16Le"
    if even * 5 >= pairs * 4 and odd * 5 <= pairs:
        return "Utf16Be"
    return None


def _detected(raw: bytes) -> Decoded:
    """The likeliest legacy encoding. Statistical, so only its strictness is guaranteed."""
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(raw, cp_isolation=sorted({*CODECS.values(), "latin_1"} - {"utf-8", "utf-16-le", "utf-16-be"})).best()
        guesses = [best.encoding] if best else []
    except ImportError:
        guesses = []
    for codec in [*guesses, "iso2022_jp", "cp932", "euc_jp", "gb18030", "big5", "cp949", "cp1252"]:
        name = codecs.lookup(codec).name
        try:
            return decode_as(raw, _BY_CODEC.get(name, f"detected:{name}"))
        except DecodeError:
            continue
    raise DecodeError("no encoding fits")


def decode_auto(raw: bytes) -> Decoded:
    """Mark, then strict UTF-8, then UTF-16 by its zeros, then the likeliest legacy encoding."""
    if not raw:
        return Decoded("", "Utf8")
    if (found := by_mark(raw)) is not None:
        return found
    try:
        return Decoded(raw.decode("utf-8"), "Utf8")
    except UnicodeDecodeError:
        pass
    if (wide := without_mark(raw)) is not None:
        return decode_as(raw, wide)
    return _detected(raw)


def looks_binary(text: str) -> bool:
    head = text[:4096]
    suspicious = sum(4 if c == "�" else 1 for c in head if c == "�" or ((c < " " or "\x7f" <= c <= "\x9f") and c not in "\n\r\t\f"))
    return bool(head) and suspicious * 20 > len(head)


def decode(raw: bytes, preference: str = AUTO) -> Decoded:
    """By preference; text that looks binary is an error."""
    found = decode_auto(raw) if preference == AUTO else decode_as(raw, preference)
    if looks_binary(found.text):
        raise DecodeError("binary")
    return found


def encode(text: str, encoding: str) -> bytes:
    """UTF-8 without a mark, UTF-16 with one; characters that the encoding lacks are an error."""
    try:
        raw = text.encode(CODECS.get(encoding) or encoding.removeprefix("detected:"))
    except UnicodeEncodeError as e:
        raise DecodeError(str(e)) from None
    return {"Utf16Le": codecs.BOM_UTF16_LE, "Utf16Be": codecs.BOM_UTF16_BE}.get(encoding, b"") + raw


def encoded(text: Column, encoding: Column) -> Column:
    """Bytes of each text in its own encoding; null where the encoding lacks a character, or is not known."""

    @F.pandas_udf("binary")
    def raw(texts: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, e in zip(texts, names, strict=True):
            try:
                out.append(encode(t, e) if t is not None else None)
            except (DecodeError, LookupError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return raw(text, encoding)


def decoded(files: DataFrame, preference: str = AUTO) -> DataFrame:
    """files(content, ...) with text and text_encoding instead of content; files that are no text are left out.

    Well-formed UTF-8, with its mark or without one, stays in the JVM; only the rest goes to Python, in small batches."""
    from ..operators.filters import looks_binary as binary

    @F.arrow_udf("struct<text:string,text_encoding:string>")
    def slow(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raw in batches:
            texts, names = [], []
            for b in raw:
                try:
                    d = decode(b.as_py(), preference) if b.is_valid else None
                except DecodeError:
                    d = None
                texts.append(d.text if d else None)
                names.append(d.encoding if d else None)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["text", "text_encoding"])

    small_batches(files.sparkSession)
    content: Column = F.col("content")
    rest = [c for c in files.columns if c != "content"]
    wide = F.substring(content, 1, 2).isin(codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) | (F.substring(content, 1, 4) == F.lit(codecs.BOM_UTF32_BE))
    easy = (F.is_valid_utf8(content.cast("string")) & ~wide) if preference == AUTO else F.lit(False)
    bare = F.when(F.substring(content, 1, 3) == F.lit(codecs.BOM_UTF8), F.expr("substring(content, 4)")).otherwise(content)
    fast = files.where(easy).select(*rest, bare.cast("string").alias("text"), F.lit("Utf8").alias("text_encoding"))
    fast = fast.where(~binary(F.col("text")))
    hard = files.where(~easy).select(*rest, slow(content).alias("d")).where("d.text IS NOT NULL").select(*rest, "d.text", "d.text_encoding")
    return fast.unionByName(hard)
