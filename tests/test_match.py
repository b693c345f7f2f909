"""Text search against a plain Python matcher, and its properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import regexes
from lodeseek.operators import diff, match, search, windows
from lodeseek.plans.conditions import PLAIN, REGEX, TOKEN, PlainTextOptions, SearchConditions

ALPHABET = ["a", "b", "A", "é", "ß", " ", "\t", "\n", "\r\n", ".", "|", "日", "😀", "(", "\\", "\ufdd0"]


def texts(n=150, seed=1):
    rng = random.Random(seed)
    out = ["", "\n", "a", "aa\n", "xa a a", "a a a", "\n\na", "é a\nab é", None]
    return out + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["ab " * 30_000]


def span(text, a, b):
    out = []
    for at in (a, b):
        head = text[:at]
        out += [head.count("\n") + 1, len(head.rsplit("\n", 1)[-1].encode())]
    return (*out, text[a:b])


def naive(text, c):
    """Hits as the contract of each mode says, without any tricks."""
    text = text or ""
    o = c.plain_text_options
    if c.search_mode == REGEX:
        return [span(text, m.start(), m.end()) for m in re.finditer(c.pattern, text)]
    if c.search_mode == TOKEN:
        return [span(text, m.start(), m.end()) for m in re.finditer(r"\s*".join(map(re.escape, c.pattern.split())), text)]
    if "\n" in c.pattern:
        return []
    out, base = [], 0
    for line in text.split("\n"):
        free = lambda i, line=line: i < 0 or i >= len(line) or line[i].isspace()
        if o.case_insensitive:
            spans = [(m.start(), m.end()) for m in re.finditer(re.escape(c.pattern), line, re.IGNORECASE)]
            spans = [(a, b) for a, b in spans if not o.whole_word or (free(a - 1) and free(b))]
        else:
            spans, at = [], 0
            while (a := line.find(c.pattern, at)) >= 0:
                b = a + len(c.pattern)
                good = not o.whole_word or (free(a - 1) and free(b))
                if good:
                    spans.append((a, b))
                at = b if good else a + 1
        out += [span(text, base + a, base + b) for a, b in spans]
        base += len(line) + 1
    return out


def found(spark, rows, c):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").repartition(3)
    got = {}
    for r in match.only_places(df, match.hits_column(df, c), "id").collect():
        got.setdefault(r.id, []).append(tuple(r[1:]))
    return got


@pytest.mark.parametrize("needle", ["a", "ab", "a a", "é", "日", ".", "|", "(", "\\", "aa", "a\nb"])
@pytest.mark.parametrize(("ci", "ww"), [(False, False), (False, True), (True, False), (True, True)])
def test_plain(spark, needle, ci, ww):
    c = SearchConditions("d", needle, search_mode=PLAIN, plain_text_options=PlainTextOptions(ci, ww))
    rows = texts()
    got = found(spark, rows, c)
    for i, t in enumerate(rows):
        assert sorted(got.get(i, [])) == sorted(naive(t, c)), (t, needle)


@pytest.mark.parametrize("pattern", ["a", "a+b?", "[ab]+", r"b\s+a", r"\.", "a|é", r"\w+", r"(?i)AB", r"[^a]b", r"\ba", "日."])
def test_regex(spark, pattern):
    c, rows = SearchConditions("d", pattern, search_mode=REGEX), texts(seed=2)
    got = found(spark, rows, c)
    for i, t in enumerate(rows):
        assert sorted(got.get(i, [])) == sorted(naive(t, c)), (t, pattern)


def test_token(spark):
    for pattern in ("a b", "( a", "a  é . b"):
        c, rows = SearchConditions("d", pattern, search_mode=TOKEN), texts(seed=3)
        got = found(spark, rows, c)
        for i, t in enumerate(rows):
            assert sorted(got.get(i, [])) == sorted(naive(t, c))
    with pytest.raises(regexes.PatternError):
        match.token_pattern("  ")


def test_empty_matches_follow_their_own_rule(spark):
    got = found(spark, ["aab"], SearchConditions("d", "a*", search_mode=REGEX))
    assert [h[4] for h in got[0]] == ["aa", ""] and got[0][1][1] == 3


def test_plain_is_an_escaped_regex(spark):
    rows = [t and t.replace("\n", " ").replace("\r", "") for t in texts(seed=4)]
    a = found(spark, rows, SearchConditions("d", "a.", search_mode=PLAIN))
    b = found(spark, rows, SearchConditions("d", regexes.escape("a."), search_mode=REGEX))
    assert a == b


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)b", r"(a)\1", "(", "[a", r"\q", "a++", "(?>a)", "*a"])
def test_patterns_that_are_no_patterns(spark, bad):
    with pytest.raises(regexes.PatternError):
        regexes.compiled(spark, bad)


def test_dialect(spark):
    for ours, text, want in [(r"(?P<x>a)", "ba", 1), (r"a$", "a\n", 0), (r"(?m)a$", "a\nb", 1), (r"\x{61}", "a", 1), (r"[[:digit:]]", "a1", 1), (r"[]a]", "]", 1), (r"\s", " ", 1), (r"\p{Greek}", "α", 1), (r"\pL", "é", 1)]:
        java = regexes.compiled(spark, ours)
        assert spark.range(1).select(F.size(F.regexp_extract_all(F.lit(text), F.lit(java), F.lit(0)))).first()[0] == want, ours


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_context_and_caps(spark):
    text = "one\ntwo x\nthree\nfour x x\nfive"
    df = files(spark, [("b.txt", text), ("a.txt", "x"), ("c.txt", "none")])
    c = SearchConditions("d", "x", context_lines=1, search_mode=PLAIN)
    hits = search.ordered(search.search(df, c)).collect()
    assert [(h.path, h.line_start, h.col_start) for h in hits] == [("a.txt", 1, 0), ("b.txt", 2, 4), ("b.txt", 4, 5), ("b.txt", 4, 7)]
    assert hits[1].context_before == ["one"] and hits[1].context_after == ["three"] and hits[1].span_lines_text == "two x"
    assert hits[0].context_before == [] and hits[0].source_language == "Rust"
    for cap, total, reached in ((0, 4, False), (4, 4, False), (3, 3, True)):
        stats = search.statistics(search.places(df, c), df, cap).first()
        assert (stats.total_matches, stats.hit_limit_reached, stats.scanned) == (total, reached, 3)
        got = search.capped_search(df, c, cap).collect()
        assert [tuple(h) for h in got] == [tuple(h) for h in hits[: cap or None]]
    zero = search.search(df, SearchConditions("d", "x", context_lines=0, search_mode=PLAIN)).collect()
    assert all(h.context_before == [] and h.context_after == [] for h in zero)
    wide = match.refreshed(search.search(df, c), df, 3).where("line_start = 2").first()
    assert wide.context_after == ["three", "four x x", "five"]
    text_of = match.with_context_text(F.array(F.lit("a")), F.lit("b"), F.array(F.lit(""), F.lit("")))
    assert spark.range(1).select(text_of).first()[0] == "a\nb"


def test_line_index(spark):
    def at(text, offset):
        line, col = match.place(F.lit(text), F.lit(offset))
        return tuple(spark.range(1).select(line, col).first())

    assert [at("ab\ncd\nef", o) for o in (0, 1, 2, 3, 5, 6, 8, 99)] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 2), (2, 2)]
    assert at("ab\n", 3) == (1, 0)


def test_multi_line_hit(spark):
    df = files(spark, [("a", "x foo\nbar y\nz")])
    h = search.search(df, SearchConditions("d", "foo bar", context_lines=1, search_mode=TOKEN)).first()
    assert (h.line_start, h.col_start, h.line_end, h.col_end) == (1, 2, 2, 3)
    assert h.span_lines_text == "x foo\nbar y" and h.context_after == ["z"]


def test_positional_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc\nd"), (2, "x", "x")], "id int, a string, b string")
    got = {i: [(r.mark, r.line) for r in diff.positional(df, "a", "b", "id").where(f"id = {i}").orderBy("no").collect()] for i in (1, 2)}
    assert got[1] == [("---", "before"), ("+++", "after"), (" ", "a"), ("-", "b"), ("+", "B"), (" ", "c"), ("+", "d")]
    assert got[2][2:] == [(" ", "x")]
    long = spark.createDataFrame([(1, "a\n" * 2000, "b\n" * 2000)], "id int, a string, b string")
    rows = diff.positional(long, "a", "b", "id").orderBy("no").collect()
    assert len(rows) == 801 and rows[-1].mark == "..."


def test_bytes_cut(spark):
    for s in ("a" * 10, "é" * 10, "日本語" * 4, "😀" * 3, "abc"):
        for most in range(4, 13):
            got = spark.range(1).select(windows.bytes_cut(F.lit(s), most)).first()[0]
            assert got == s.encode()[:most].decode("utf-8", "ignore"), (s, most)


def test_expanded_tabs(spark):
    df = spark.createDataFrame([("a\tb\n\tc",), ("x",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(windows.expand_tabs(F.col("t"))).collect()] == ["a   b\n    c", "x", None]


def test_batch(spark):
    from lodeseek.plans.conditions import PatternJob

    df = files(spark, [("a.txt", "x y x"), ("b.txt", "y")])
    c = lambda p, mode=PLAIN: SearchConditions("d", p, search_mode=mode)
    jobs = [PatternJob(1, "x", True, c("x")), PatternJob(2, "bad", True, c("(", REGEX)), PatternJob(3, "off", False, c("y")), PatternJob(4, "y", True, c("y")), PatternJob(5, "blank", True, c("  "))]
    report = search.run_batch(lambda _: df, jobs)
    assert [r.job.id for r in report.runs] == [1, 2, 4]
    assert (report.total_matches, report.total_files, report.failed) == (4, 3, 1)
    assert sorted((r.job_id, r.path) for r in report.hits().collect()) == [(1, "a.txt"), (1, "a.txt"), (4, "a.txt"), (4, "b.txt")]
    with pytest.raises(search.NothingToRun):
        search.run_batch(lambda _: df, [jobs[2]])


def test_batch_totals_beyond_the_default_cap(spark, tmp_path):
    """a6_failed counts every hit, as its SQL does, also where there are more than searches return by default."""
    from lodeseek import queries
    from lodeseek.plans.conditions import DEFAULT_MAX_HITS

    each = DEFAULT_MAX_HITS // 2 + 1
    docs = [(i, "er no\n" * each, "en", "s", 6 * each) for i in (1, 2)] + [(3, "none", "en", "s", 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert tuple(queries.QUERIES["a6_failed"](spark, str(tmp_path)).first()) == (3, 2, 2 * each, 2)


def test_streaming_search(spark, tmp_path):
    from lodeseek.streaming import search as streaming

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, [("a", "x\nx"), ("b", "y")]).write.parquet(src)
    c = SearchConditions("d", "x", search_mode=PLAIN)

    def once():
        s = streaming.arriving(spark, src, "path string, text string", "path", "text")
        streaming.to_table(streaming.hits(s, c), out, str(tmp_path / "ck")).awaitTermination(120)

    once()
    assert spark.read.parquet(out).count() == 2
    files(spark, [("c", "x")]).write.mode("append").parquet(src)
    once()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["a", "a", "c"]


def test_places_of_all_documents(spark, sf):
    """Byte offsets of any text, within characters, too."""
    from lodeseek.queries import QUERIES

    def want(rows, offsets):
        heads = [(i, o, t.encode()[:o]) for i, t in rows if t is not None for o in offsets]
        return sorted((i, o, h.count(b"\n"), len(h) - h.rfind(b"\n") - 1) for i, o, h in heads)

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["m10_place_bytes"](spark, sf).collect())
    assert got == want(docs, (0, 7, 500, 100000)) and any(not t.isascii() for _, t in docs if t)
    texts = [(1, "é\nà日\n"), (2, "\né"), (3, "")]
    rows = spark.createDataFrame([(i, t, o) for i, t in texts for o in range(12)], "i long, t string, o int")
    line, col = match.place(F.col("t"), F.col("o"))
    assert sorted(tuple(r) for r in rows.select("i", "o", line, col).collect()) == want(texts, range(12))
