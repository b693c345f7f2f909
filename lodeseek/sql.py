"""The same operations as SQL functions.

    SELECT d.doc_id, h.* FROM documents d, LATERAL search_plain(d.text, 'er') h
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf

from .functions import encodings, regexes
from .operators import explain, match
from .operators.syntax import matcher
from .operators.syntax.spark import _rows as syntax_rows
from .sources.tree import TreeSource

_HIT = match.HIT


def _rows(text: str, spans: Iterator[tuple[int, int]]) -> Iterator[tuple]:
    for a, b in spans:
        where = []
        for at in (a, b):
            head = text[:at]
            where += [head.count("\n") + 1, len(head.rsplit("\n", 1)[-1].encode())]
        yield (*where, text[a:b])


class SearchRegex:
    def eval(self, text: str, pattern: str):
        if text is not None:
            yield from _rows(text, match._spans_with_empties(regexes.translate(pattern))(text))


class SearchPlain:
    def eval(self, text: str, needle: str):
        if text and needle and "\n" not in needle:
            yield from _rows(text, ((m.start(), m.end()) for m in re.finditer(re.escape(needle), text)))


class SearchToken:
    def eval(self, text: str, pattern: str):
        words = (pattern or "").split()
        if text and words:
            yield from _rows(text, ((m.start(), m.end()) for m in re.finditer(r"\s*".join(map(re.escape, words)), text)))


class SearchSyntax:
    def eval(self, text: str, pattern: str, lang: str):
        for r in syntax_rows(text or "", lang, pattern, "$RECV" in pattern):
            yield tuple(r[c] for c in (*match.HIT_COLUMNS, "recv_type_hint"))


class RegexTokens:
    def eval(self, pattern: str):
        for i, t in enumerate(explain.tokens(pattern or "")):
            yield i, t.kind, t.text, t.depth, t.label


def rewrite_syntax(text: str, pattern: str, template: str, lang: str) -> str | None:
    done = matcher.rewrite(text or "", pattern, template, lang)
    if done and done[2]:
        raise matcher.RewriteProblem("the rewrite does not end within the pass limit")
    return done[0] if done else None


def decode_auto(raw: bytes) -> str | None:
    try:
        return encodings.decode(bytes(raw)).text if raw is not None else None
    except encodings.DecodeError:
        return None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
    tables = {
        "search_regex": (SearchRegex, _HIT), "search_plain": (SearchPlain, _HIT), "search_token": (SearchToken, _HIT),
        "search_syntax": (SearchSyntax, f"{_HIT}, recv_type_hint string"), "regex_tokens": (RegexTokens, "no int, kind string, token string, depth int, label string"),
    }
    for name, (cls, schema) in tables.items():
        spark.udtf.register(name, udtf(cls, returnType=schema))
    spark.udf.register("rewrite_syntax", udf(rewrite_syntax, "string"))
    spark.udf.register("decode_auto", udf(decode_auto, "string"))
    spark.udf.register("regex_tree", udf(lambda p: explain.explain(p).tree_json() if p is not None else None, "string"))
