import random
import time

import pyarrow as pa
import pytest
import regex

from lodeseek.functions import automaton, regexes
from lodeseek.operators import match, search
from lodeseek.plans.conditions import REGEX, SearchConditions


def by_backtracking(pattern, text):
    """Hits as the dialect has them: leftmost, first alternative, no empty one right behind another."""
    out, at, end = [], 0, None
    p = regex.compile(pattern)
    while (m := p.search(text, at)) is not None:
        if m.start() == m.end() == end:
            at = end + 1
            if at > len(text):
                break
            continue
        at = end = m.end()
        place = [(h.count("\n") + 1, len(h.rsplit("\n", 1)[-1].encode())) for h in (text[: m.start()], text[: m.end()])]
        out.append((*place[0], *place[1], m.group()))
    return out


def found(pattern, texts):
    re2 = automaton.in_automaton_terms(pattern)
    assert re2 is not None, pattern
    return [[tuple(h.values()) for h in hits] for hits in automaton.hits(pa.array(texts, pa.string()), re2).to_pylist()]


def random_pattern(g, depth=0):
    kind = g.random()
    if depth > 2 or kind < 0.35:
        return g.choice(["a", "b", "é", r"\n", "[ab]", "[^a]", ".", r"\d", "[a-cé]"])
    if kind < 0.6:
        return random_pattern(g, depth + 1) + random_pattern(g, depth + 1)
    if kind < 0.8:
        return "(?:" + random_pattern(g, depth + 1) + "|" + random_pattern(g, depth + 1) + ")"
    inner = random_pattern(g, depth + 1)
    # a repetition of what may be empty is where engines differ among themselves
    inner = inner if regex.match(f"(?:{inner})\\Z", "") is None else "[ab]"
    return f"(?:{inner})" + g.choice(["*", "+", "?", "{1,3}", "*?", "+?"])


def test_a_thousand_patterns_like_a_second_engine():
    g = random.Random(3)
    for _ in range(1000):
        pattern = random_pattern(g)
        texts = ["".join(g.choice("abcé1\n x") for _ in range(g.randrange(40))) for _ in range(4)]
        assert found(pattern, texts) == [by_backtracking(pattern, t) for t in texts], pattern


def test_nulls_empties_marks_and_long_texts():
    assert found("a*", [None, "", "ba"]) == [[], [(1, 0, 1, 0, "")], [(1, 0, 1, 0, ""), (1, 1, 1, 2, "a")]]
    assert found("x", ["﷐x﷑x"]) == [[(1, 3, 1, 4, "x"), (1, 7, 1, 8, "x")]]
    assert found("x", []) == []
    began = time.time()
    for pattern, text in ((r"(?:x|y)+z", "xy" * 500_000 + "z"), (r"/[*](?:.|\n)*[*]/", "/*" + "a\n" * 500_000 + "*/"), (r"(?:a+)+b", "a" * 100_000)):
        want = [] if pattern.endswith("b") else [text]
        assert [h[4] for h in found(pattern, [text])[0]] == want
    assert time.time() - began < 20


@pytest.mark.parametrize(("pattern", "deep"), [("(?:x|y)+z", True), (r"/[*](?:.|\n)*[*]/", True), ("(ab){2,4}", False), ("(ab){2,}", True), ("(ab){9,99}", True), ("(a|b)?c", False), (r"\(a\)+", False), ("[)]+", False), ("[a-z]+tion", False), (r"[\])]*x", False)])
def test_which_patterns_are_kept_from_java(pattern, deep):
    assert regexes.recurses(pattern) is deep


def test_terms():
    for pattern in (r"\bfoo", r"[a&&b]", r"(?x) a", r"[\W]", r"[[a]b]"):
        assert automaton.in_automaton_terms(pattern) is None
    assert found(r"\d+\s\w", ["१२ é"]) == [[(1, 0, 1, 10, "१२ é")]]
    assert found(r"(?P<n>\u{41})", ["xA"]) == [[(1, 1, 1, 2, "A")]]


def test_search_survives_long_repeats(spark):
    files = spark.createDataFrame([("a.c", "int x; /*" + "ab\n" * 100_000 + "*/ y"), ("b.c", "xy" * 20_000 + "z"), ("c.c", None)], "path string, text string")
    for pattern, places in ((r"/[*](?:.|\n)*[*]/", [("a.c", 1, 7, 100_001, 2)]), ("(?:x|y)+z", [("b.c", 1, 0, 1, 40_001)]), (r"\b(?:x|y)+z", [("b.c", 1, 0, 1, 40_001)])):
        hits = search.places(files, SearchConditions("d", pattern, search_mode=REGEX))
        assert [tuple(r) for r in hits.select("path", "line_start", "col_start", "line_end", "col_end").collect()] == places
    plan = files.select(match.hits_column(files, SearchConditions("d", "(?:x|y)+z", search_mode=REGEX)).alias("h"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
