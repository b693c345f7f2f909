"""Text search as expressions: a row of text in, a row for each hit out.

Matches are marked in the text, the marked text is split into lines, and what stands before a mark in its line gives
its byte column. Long texts are split at their matches instead, and walked through once. No Python runs, except for
patterns that can match nothing at all, whose empty hits follow rules of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import automaton, regexes
from ..plans.conditions import PLAIN, REGEX, TOKEN, SearchConditions

HIT = "line_start int, col_start int, line_end int, col_end int, matched_text string"
HIT_COLUMNS = [c.split()[0] for c in HIT.split(", ")]
_HITS = f"array<struct<{', '.join(c.replace(' ', ':') for c in HIT.split(', ')).replace(' ', '')}>>"


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_and_col(prefix: Column) -> tuple[Column, Column]:
    """0-based line and byte column of the place behind a prefix of the text."""
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))), F.octet_length(F.substring_index(prefix, "\n", -1))


def place(text: Column, byte_offset: Column) -> tuple[Column, Column]:
    """0-based line and byte column of a byte offset; offsets beyond the end count as the end."""
    raw = F.encode(text, "UTF-8")
    # a character for each byte, as an offset may lie within one of the text's characters
    head = F.decode(F.substring(raw, F.lit(1), F.least(byte_offset, F.octet_length(text))), "ISO-8859-1")
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))), F.length(F.substring_index(head, "\n", -1))


#: Two characters that no text holds (Unicode reserves them from exchange); texts that do are searched the slow way.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
_MARK_BYTES = 3
#: Texts of more bytes are searched the slow way, too: marks are counted from the start of their line.
MARKED_BYTES = 1 << 16
_BLOCK = 256


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none() -> Column:
    return F.array().cast(_HITS)


def _count(s: Column, mark: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))


def _head(line: Column, mark: str, k: Column) -> Column:
    """What stands before the k-th mark."""
    return F.call_function("substring_index", line, F.lit(mark), k)


def _numbered(line: Column, mark: str, body) -> Column:
    """body(k) for the k-th mark of a line, from 1."""
    return _bound(_count(line, mark), lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), body)).otherwise(F.transform(F.array().cast("array<int>"), body)))


def _hit(line1: Column, col1: Column, line2: Column, col2: Column, text: Column) -> Column:
    return F.struct(line1.alias("line_start"), col1.alias("col_start"), line2.alias("line_end"), col2.alias("col_end"), text.alias("matched_text"))


def _within_lines(marked: Column) -> Column:
    """Hits of a marked text none of which crosses a line end."""

    def one(line: Column, i: Column, k: Column) -> Column:
        found = F.substring_index(_head(line, CLOSE, k), OPEN, -1)
        # k - 1 marks of either kind stand before it
        start = F.octet_length(_head(line, OPEN, k)) - (k - 1) * (2 * _MARK_BYTES)
        return _bound(F.struct(found.alias("found"), start.alias("start")), lambda x: _hit(i + 1, x["start"], i + 1, x["start"] + F.octet_length(x["found"]), x["found"]))

    return F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: _numbered(line, OPEN, lambda k: one(line, i, k))))


def _across_lines(marked: Column, found: Column) -> Column:
    """Hits of a marked text that may cross line ends: the n-th opening mark belongs to the n-th closing one."""

    def places(mark: str, other: str) -> Column:
        def one(line: Column, i: Column, k: Column) -> Column:
            return _bound(_head(line, mark, k), lambda head: F.struct((i + 1).alias("line"), (F.octet_length(head) - (k - 1 + _count(head, other)) * _MARK_BYTES).alias("col")))

        return F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: _numbered(line, mark, lambda k: one(line, i, k))))

    ends = F.zip_with(places(CLOSE, OPEN), found, lambda e, m: F.struct(e.alias("at"), m.alias("found")))
    return F.zip_with(places(OPEN, CLOSE), ends, lambda s, e: _hit(s["line"], s["col"], e["at"]["line"], e["at"]["col"], e["found"]))


def _walked(gaps: Column, found: Column) -> Column:
    """Hits of a text from the gaps around its matches and the matches, in one pass: linear in long texts, slow for each hit."""

    def moved(at: Column, s: Column) -> Column:
        lines, col = line_and_col(s)
        return F.struct((at["line"] + lines).alias("line"), F.when(lines == 0, at["col"] + col).otherwise(col).alias("col"))

    def step(acc: Column, piece: Column) -> Column:
        places = lambda start: _bound(moved(start, piece["found"]), lambda end: F.struct(end.alias("at"), F.array_append(acc["out"], _hit(start["line"], start["col"], end["line"], end["col"], piece["found"])).alias("out")))
        return _bound(moved(acc["at"], piece["gap"]), places)

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("col"))

    def block(all_: Column, acc: Column, b: Column) -> Column:
        # arrays are copied when they grow, so hits are gathered in blocks
        walked = F.aggregate(F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(acc["at"].alias("at"), _none().alias("out")), step)
        return _bound(walked, lambda w: F.struct(w["at"].alias("at"), F.array_append(acc["out"], w["out"]).alias("out")))

    def whole(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")))
        begin = F.struct(start.alias("at"), F.array().cast(f"array<{_HITS}>").alias("out"))
        return F.flatten(F.aggregate(blocks, begin, lambda acc, b: block(all_, acc, b), lambda a: a["out"]))

    return _bound(pairs, whole)


def _markable(text: Column) -> Column:
    return (F.octet_length(text) <= MARKED_BYTES) & ~F.contains(text, F.lit(OPEN)) & ~F.contains(text, F.lit(CLOSE))


def _all(text: Column, java: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java), F.lit(0))


def regex_hits(text: Column, java: str, one_line: bool = False, marked: Column | None = None) -> Column:
    """Hits of a Java pattern that never matches nothing, over the whole text. one_line: no match holds a line end."""
    if marked is None:
        marked = F.regexp_replace(text, java, f"{OPEN}$0{CLOSE}")
    fast = _within_lines(marked) if one_line else _across_lines(marked, _all(text, java))
    slow = _bound(F.struct(F.split(text, java, -1).alias("gaps"), _all(text, java).alias("found")), lambda p: _walked(p["gaps"], p["found"]))
    return F.when(_markable(text), fast).otherwise(slow)


def _delimited(text: Column, java: str) -> Column:
    """All hits first, then those whose neighbours are white space or an edge of the text."""
    last, first = lambda s: F.substring(s, -1, 1), lambda s: F.substring(s, 1, 1)
    free = lambda c: (c == "") | c.rlike(r"(?U)^\s$")

    def alone(gaps: Column, found: Column, i: Column) -> Column:
        before = F.when(F.get(gaps, i) != "", last(F.get(gaps, i))).otherwise(F.coalesce(last(F.get(found, i - 1)), F.lit("")))
        after = F.when(F.get(gaps, i + 1) != "", first(F.get(gaps, i + 1))).otherwise(F.coalesce(first(F.get(found, i + 1)), F.lit("")))
        return free(before) & free(after)

    pieces = F.struct(F.split(text, java, -1).alias("gaps"), _all(text, java).alias("found"), regex_hits(text, java, True).alias("hits"))
    return _bound(pieces, lambda p: F.filter(p["hits"], lambda _, i: alone(p["gaps"], p["found"], i)))


def plain_hits(text: Column, needle: str, case_insensitive: bool = False, whole_word: bool = False) -> Column:
    """Hits of a text within lines; a whole word has white space or an edge of its line on either side."""
    if "\n" in needle or needle == "":
        return _none()
    literal = regexes.escape(needle)
    if case_insensitive:
        return _delimited(text, f"(?iu){literal}") if whole_word else regex_hits(text, f"(?iu){literal}", True)
    if whole_word:
        found = regex_hits(text, rf"(?U)(?<!\S){literal}(?!\S)", True)
    else:
        found = regex_hits(text, literal, True, F.replace(text, F.lit(needle), F.lit(OPEN + needle + CLOSE)))
    # the cheap test keeps texts without the needle from being split
    return F.when(F.contains(text, F.lit(needle)), found).otherwise(_none())


def token_pattern(pattern: str) -> str:
    """Words of the pattern in order, with any white space between them."""
    words = pattern.split()
    if not words:
        raise regexes.PatternError("empty token pattern")
    return r"(?U)" + r"\s*".join(regexes.escape(w) for w in words)


def _spans_with_empties(java_like: str):
    """Byte spans by a backtracking engine; an empty match right behind another match is passed over."""
    import regex

    p = regex.compile(java_like.removeprefix("(?dU)").replace(r"\z", r"\Z"))

    def spans(text: str) -> Iterator[tuple[int, int]]:
        at, end = 0, None
        while at <= len(text) and (m := p.search(text, at)) is not None:
            if m.start() == m.end() == end:
                at = end + 1
                continue
            at = end = m.end()
            yield m.start(), m.end()

    return spans


def _python_hits(java: str):
    @F.pandas_udf(_HITS)
    def hits(texts: pd.Series) -> pd.Series:
        spans, out = _spans_with_empties(java), []
        for t in texts:
            rows = []
            for a, b in spans(t or ""):
                where = []
                for at in (a, b):
                    head = t[:at]
                    where += [head.count("\n") + 1, len(head.rsplit("\n", 1)[-1].encode())]
                rows.append((*where, t[a:b]))
            out.append([dict(zip(HIT_COLUMNS, (r[0], r[1], r[2], r[3], r[4]), strict=True)) for r in rows])
        return pd.Series(out)

    return hits


def hits_column(files: DataFrame, conditions: SearchConditions, text: str = "text") -> Column:
    """The array of a text's hits under plain, token or regex conditions. PatternError for a bad pattern."""
    col, mode = F.col(text), conditions.search_mode
    if mode == PLAIN:
        o = conditions.plain_text_options
        return plain_hits(col, conditions.pattern, o.case_insensitive, o.whole_word)
    if mode == TOKEN:
        return regex_hits(col, token_pattern(conditions.pattern))
    if mode != REGEX:
        raise ValueError(f"{mode} is not a text mode")
    java = regexes.compiled(files.sparkSession, conditions.pattern)
    sure = regexes.literal_prefix(conditions.pattern)
    if regexes.recurses(conditions.pattern) or regexes.may_be_empty(files.sparkSession, java):
        # texts without the sure prefix are nulls to the function
        some = F.when(F.contains(col, F.lit(sure)), col) if sure else col
        safe = automaton.in_automaton_terms(conditions.pattern)
        return automaton.hits_column(some, safe, _HITS) if safe is not None else _python_hits(java)(some)
    hits = regex_hits(col, java, regexes.stays_in_line(conditions.pattern))
    return F.when(F.contains(col, F.lit(sure)), hits).otherwise(_none()) if sure else hits


def context(lines: Column, hit: Column, n: int) -> list[Column]:
    """Whole lines of the hit, and up to n lines before and after it."""
    count = F.size(lines)
    first = F.greatest(F.lit(1), hit["line_start"] - n)
    before = F.slice(lines, first, F.greatest(F.lit(0), F.least(hit["line_start"] - 1, count) - first + 1))
    after = F.slice(lines, hit["line_end"] + 1, F.greatest(F.lit(0), F.least(F.lit(n), count - hit["line_end"])))
    span = F.when(hit["line_start"] > count, F.lit("")).otherwise(F.array_join(F.slice(lines, hit["line_start"], F.least(hit["line_end"], count) - hit["line_start"] + 1), "\n"))
    return [span.alias("span_lines_text"), before.alias("context_before"), after.alias("context_after")]


def exploded(files: DataFrame, hits: Column, n: int = 0, *keep: str, text: str = "text") -> DataFrame:
    """A row for each hit: keep columns, its number within the text, its place, and the lines around it.

    Context is cut inside the array, so that the text itself is not copied for every hit."""
    found = files.select(*keep, F.col(text).alias("__text"), hits.alias("__hits")).where(F.size("__hits") > 0)
    found = found.select(*keep, "__hits", lines_of(F.col("__text")).alias("__lines"))
    full = F.transform("__hits", lambda h: F.struct(*[h[c].alias(c) for c in HIT_COLUMNS], *context(F.col("__lines"), h, n)))
    rows = found.select(*keep, F.posexplode(full).alias("hit_no", "hit"))
    return rows.select(*keep, (F.col("hit_no") + 1).alias("hit_no"), "hit.*")


def only_places(files: DataFrame, hits: Column, *keep: str) -> DataFrame:
    """A row for each hit, without context."""
    return files.select(*keep, F.explode(hits).alias("hit")).select(*keep, "hit.*")


def with_context(hits: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Context for few hits(path, ...): they are sent to the files, whose texts stay where they are."""
    per = hits.groupBy("path").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "path"])).alias("__hits"))
    # hits are capped by the caller
    met = files.select("path", "text").join(F.broadcast(per), "path").select("path", "__hits", lines_of(F.col("text")).alias("__lines"))
    names = [c for c in hits.columns if c != "path"]
    full = F.transform("__hits", lambda h: F.struct(*[h[c].alias(c) for c in names], *context(F.col("__lines"), h, n)))
    return met.select("path", F.explode(full).alias("hit")).select("path", "hit.*")


def with_context_text(before: Column, center: Column, after: Column) -> Column:
    """Lines before, the hit's own, lines after, without line ends behind."""
    all_ = F.concat(before, F.array(center), after)
    return F.rtrim(F.array_join(all_, "\n"), F.lit("\n"))


def refreshed(hits: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Hits with contexts of another width, from their files; hits of files that are gone keep theirs."""
    lines = files.select("path", lines_of(F.col("text")).alias("__lines"))
    hit = F.struct("line_start", "line_end")
    _, before, after = context(F.col("__lines"), hit, n)
    joined = hits.join(lines, "path", "left")
    return joined.withColumns({
        "context_before": F.when(F.col("__lines").isNotNull(), before).otherwise(F.col("context_before")),
        "context_after": F.when(F.col("__lines").isNotNull(), after).otherwise(F.col("context_after")),
    }).drop("__lines")
