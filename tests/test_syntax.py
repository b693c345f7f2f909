"""Syntax patterns, rewriting, receivers, suggestions, explanations."""

import pytest

from lodeseek import queries
from lodeseek.functions.regexes import PatternError
from lodeseek.operators import explain, search, suggest
from lodeseek.operators.syntax import matcher, receivers
from lodeseek.operators.syntax import spark as syntax
from lodeseek.operators.syntax.lexer import SyntaxProblem
from lodeseek.plans.conditions import SearchConditions


def hits(source, pattern, lang):
    return [source[h.start : h.end] for h in matcher.find(source, pattern, lang)]


@pytest.mark.parametrize(
    ("source", "pattern", "lang", "want"),
    [
        ('var t="</p>";track(12);', "track($N)", "JavaScript", ["track(12)"]),
        ("a.b().c(1, 2) + d(x * y + z);", "$R.$M($$$A)", "Java", ["a.b().c(1, 2)", "a.b()"]),
        ("a * b + c", "$A + $B", "Python", ["a * b + c"]),
        ("a * b + c * d", "b + c", "Python", []),
        ("if (x == null) { f(x); } else if (y == null) g();", "$V == null", "Java", ["x == null", "y == null"]),
        ("fn m() { let v = x.unwrap(); y.z().unwrap(); }", "$V.unwrap()", "Rust", ["x.unwrap()", "y.z().unwrap()"]),
        ("fn m(a: i32) -> u8 { panic!(\"x\", 1); }", "fn $N($$$A)", "Rust", ["fn m(a: i32)"]),
        ("fn f() { panic!(\"x {}\", 1); }", "panic!($$$A)", "Rust", ['panic!("x {}", 1)']),
        ("import os\nimport sys\nprint(1)\n", "import $M", "Python", ["import os", "import sys"]),
        ("def f(x):\n    print(x)\n    return x\ny = 1\n", "def $F($$$A): $$$B", "Python", ["def f(x):\n    print(x)\n    return x"]),
        ("x = f(a, a); y = f(a, b)", "f($X, $X)", "JavaScript", ["f(a, a)"]),
        ("if err != nil { return err }\n", "if err != nil { $$$BODY }", "Go", ["if err != nil { return err }"]),
        ("foo::bar(1); ns::foo::bar(x).baz();", "foo::bar($$$A)", "C++", ["foo::bar(1)"]),
        ('log("a", b); /* log(1) */ "log(2)"; // log(3)', "log($$$A)", "TypeScript", ['log("a", b)']),
        ("class A extends B { void m() {} }", "class $N extends $P { $$$ }", "Java", ["class A extends B { void m() {} }"]),
        ("f(1, 2, 3); f(); f(1)", "f($A, $$$REST)", "Python", ["f(1, 2, 3)", "f(1)"]),
        ("f(  a ,b )", "f(a, b)", "Java", ["f(  a ,b )"]),
        ("x == null && y", "$A && $B", "Java", ["x == null && y"]),
        ("a = b + c", "$A = $B", "Python", ["a = b + c"]),
        ("", "f($A)", "Rust", []),
    ],
)
def test_patterns(source, pattern, lang, want):
    assert hits(source, pattern, lang) == want


@pytest.mark.parametrize("bad", ["", "  ", "f(", "f)", "$$$X"])
def test_bad_patterns(bad):
    with pytest.raises(SyntaxProblem):
        matcher.Matcher(bad, "Java")


def test_every_probe_and_preset_compiles():
    from lodeseek.functions import languages

    for lang in languages.LANGUAGES:
        for pattern, _ in suggest.PROBES[lang] + suggest.GENERIC + [(p, n) for n, p in languages.presets(lang)]:
            assert matcher.strategies(pattern, lang)


def test_rewrite():
    rw = matcher.rewrite
    assert rw("print(1)", "print($X)", "log($X)", "Auto") is None
    assert rw("x = 1", "print($X)", "log($X)", "Python") is None
    assert rw("print(1)", "", "x", "Python") is None
    assert rw("print(1); print(2)", "print($X)", "log($X)", "Python") == ("log(1); log(2)", 2, False)
    assert rw("let a = b.unwrap();", "$V.unwrap()", '$V.expect("x")', "Rust")[0] == 'let a = b.expect("x");'
    assert rw("f(f(1))", "f($A)", "g($A)", "Python") == ("g(g(1))", 2, False)
    text, edits, limit = rw("f(1)", "f($A)", "f(f($A))", "Python", 5)
    assert limit and edits == 5
    once = rw("a(1, 2)", "a($$$X)", "b($$$X)", "Java")
    assert once[0] == "b(1, 2)" and rw(once[0], "a($$$X)", "b($$$X)", "Java") is None


def test_deep_rewrites_end(spark, tmp_path):
    deep = "f(" * 150 + "x" + ")" * 150
    assert matcher.rewrite(deep, "f($A)", "g($A)", "Python") == (deep.replace("f", "g"), 150, False)
    chain = " + ".join(f"a{i}" for i in range(130))
    text, edits, limit = matcher.rewrite(chain, "$A + $B", "add($A, $B)", "Python")
    assert "+" not in text and edits >= 129 and not limit
    # what grows without end is found out; what only moves its values is not
    assert matcher.endless("f($A)", "f(f($A))", "Python")
    assert not matcher.endless("f($A, $B, $C)", "f(long, $A, $B)", "Python") and not matcher.endless("f($A)", "g(h($A), h($A))", "Python")
    files = spark.createDataFrame([("a.py", "Python", deep), ("b.py", "Python", "f(1)")], "path string, source_language string, text string")
    out = {r.path: r for r in syntax.rewritten(files, "f($A)", "g($A)", "Python").collect()}
    assert out["a.py"].after == deep.replace("f", "g") and out["b.py"].after == "g(1)"
    endless = syntax.rewritten(files, "f($A)", "f(f($A))", "Python")
    assert all(r.after is None and r.hit_pass_limit and r.error for r in endless.collect())
    assert syntax.write_back(endless, str(tmp_path)).count() == 0


def recv(source, pattern, lang):
    return [(source[a:b], receivers.receiver_type(source, lang, source[a:b], a)) for h in matcher.find(source, pattern, lang) for a, b in [h.names["RECV"]]]


def test_receivers_java():
    assert recv('class A { String f(String s) { if (s == null || s.isEmpty()) return ""; return s; } }', "$RECV.isEmpty()", "Java") == [("s", "String")]
    got = dict(recv("class A { Foo z; void f(java.util.List<String> xs) { java.util.List<String> out = new java.util.ArrayList<>(); for (String line : xs) { out.add(line.trim()); } var q = foo(); q.bar(); z.k(); this.g(); xs.forEach(x -> x.baz()); } }", "$RECV.$M($$$A)", "Java"))
    assert got == {"out": "java.util.List<String>", "line": "String", "q": "var:(foo())", "z": "Foo", "this": "A", "xs": "java.util.List<String>", "x": None}


def test_receivers_cpp():
    got = recv('void f() { int a = 1; CString b = a; a.foo(); CTime time = now(); time.Format("%Y").Format("x"); CString s1, s2, s3; s3.Format("y"); }', "$RECV.$M($$$A)", "C++")
    assert got == [("a", "int"), ('time.Format("%Y")', "CTime"), ("time", "CTime"), ("s3", "CString")]
    got = recv("void Foo::bar(const CString & s, CString&& r, const ATL::CStringW &w) { s.a(); r.b(); w.c(); }", "$RECV.$M($$$A)", "C++")
    assert got == [("s", "const CString &"), ("r", "CString &&"), ("w", "const ATL::CStringW &")]
    assert recv("void f(CString *p) { p->Format(1); }", "$RECV->$M($$$A)", "C++") == [("p", "CString *")]
    assert recv("class A { B m_b; void f() { m_b.go(); this->x(); } };", "$RECV.go()", "C++") == [("m_b", "B")]


def test_receivers_cpp_headers():
    source = '#include "../inc/foo.h"\nvoid Foo::bar() { m_x.go(); }'
    texts = {"a/inc/foo.h": '#include "base.h"\n', "a/inc/base.h": '#include "foo.h"\nclass Foo { CThing m_x; };'}
    at = source.index("m_x")
    assert receivers.receiver_type(source, "C++", "m_x", at, "a/src/foo.cpp", texts.get) == "CThing"
    assert receivers.receiver_type(source, "C++", "m_x", at, "a/src/foo.cpp", lambda p: None) is None


def test_receivers_others():
    assert recv("impl Foo for Bar { fn x(&self) { self.y(); let v: Vec<u8> = z(); v.len(); } }", "$RECV.$M($$$A)", "Rust") == [("self", "Bar"), ("v", "Vec<u8>")]
    assert recv("func (r *Repo) Get() { r.Query() }", "$RECV.$M($$$A)", "Go") == [("r", "*Repo")]
    assert recv("class A { private x: Foo; m() { const b: Bar = q(); b.c(); this.d(); x.e(); } }", "$RECV.$M($$$A)", "TypeScript") == [("b", "Bar"), ("this", "A"), ("x", "Foo")]
    assert recv("class A:\n    n: int = 1\n    def f(self):\n        self.g()\n        n.h()\n", "$RECV.$M($$$A)", "Python") == [("self", "A"), ("n", "int")]
    assert recv("class A { Q f; void G() { Foo b = new Foo(); b.Bar(); f.Z(); } }", "$RECV.$M($$$A)", "C#") == [("b", "Foo"), ("f", "Q")]
    assert recv("class A { fun f() { this.g() } }", "$RECV.$M($$$A)", "Kotlin") == [("this", "A")]
    assert recv("object A { def f() = { this.g() } }", "$RECV.$M($$$A)", "Scala") == [("this", "A")]
    assert recv("void f() { int a; a.b(); }", "$RECV.$M($$$A)", "C") == [("a", None)]


def test_search_and_rewrite_in_spark(spark):
    df = spark.createDataFrame([("src/a.py", "x.go(1)\nprint(x)\n"), ("src/b.rs", "x.go(2);"), ("notes.txt", "x.go(3)"), ("c.PY", "x.go(4)")], "path string, text string")
    got = search.ordered(search.search(df, SearchConditions("d", "$RECV.go($A)", context_lines=1))).collect()
    assert [(h.path, h.source_language, h.matched_text) for h in got] == [("src/a.py", "Python", "x.go(1)"), ("src/b.rs", "Rust", "x.go(2)")]
    assert got[0].context_after == ["print(x)"]
    fixed = search.search(df, SearchConditions("d", "x.go($A)", "Python", file_filter="*"))
    assert fixed.count() == 4
    with pytest.raises(PatternError):
        search.search(df, SearchConditions("d", "f(", "Python"))
    langs = df.withColumn("source_language", __import__("pyspark").sql.functions.lit("Python"))
    out = syntax.rewritten(langs, "x.go($A)", "x.come($A)", "Python", fixed.where("path like 'src%'")).collect()
    assert sorted((r.path, r.after, r.replacements) for r in out) == [("src/a.py", "x.come(1)\nprint(x)\n", 1), ("src/b.rs", "x.come(2);", 1)]


def test_headers_in_spark(spark):
    rows = [("src/foo.cpp", '#include "../inc/foo.h"\nvoid Foo::bar() { m_x.go(); }'), ("inc/foo.h", '#include "base.h"\n'), ("inc/base.h", "class Foo { CThing m_x; };")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = search.search(df, SearchConditions("d", "$RECV.go()", "C++")).collect()
    assert [(h.path, h.recv_type_hint) for h in got] == [("src/foo.cpp", "CThing")]


def test_write_back(spark, tmp_path):
    df = spark.createDataFrame([("d/a.py", "Python", "f(1)", "g(1)"), ("b.py", "Python", "f(é)", "g(é)")], "path string, source_language string, before string, after string")
    assert [r.error for r in syntax.write_back(df, str(tmp_path)).collect()] == [None, None]
    assert (tmp_path / "d/a.py").read_text() == "g(1)" and (tmp_path / "b.py").read_text() == "g(é)"
    errors = syntax.write_back(df, str(tmp_path), "Iso2022Jp").where("error IS NOT NULL").collect()
    assert [r.path for r in errors] == ["b.py"]


def test_write_back_in_recorded_encodings(spark, tmp_path):
    (tmp_path / "jis.py").write_bytes("f('日本')".encode("cp932"))
    files = [("jis.py", "Python", "ShiftJis", "f('日本')"), ("wide.py", "Python", "Utf16Be", "f(1)"), ("late.py", "Python", "Windows1252", "f('日')"), ("none.py", "Python", None, "f(2)"), ("odd.py", "Python", "detected:nothing", "f(3)")]
    preview = syntax.rewritten(spark.createDataFrame(files, "path string, source_language string, text_encoding string, text string"), "f($A)", "g($A)", "Python")
    errors = {r.path: r.error for r in syntax.write_back(preview, str(tmp_path)).collect()}
    assert {p for p, e in errors.items() if e is None} == {"jis.py", "wide.py", "none.py"} and len(errors) == 5
    assert (tmp_path / "jis.py").read_bytes() == "g('日本')".encode("cp932")
    assert (tmp_path / "wide.py").read_bytes() == b"\xfe\xff" + "g(1)".encode("utf-16-be") and (tmp_path / "none.py").read_bytes() == b"g(2)"
    # nothing is left half done, not even where a file could not be put in its place
    (tmp_path / "taken").mkdir()
    taken = spark.createDataFrame([("taken", "x")], "path string, after string")
    assert syntax.write_back(taken, str(tmp_path)).first().error and not list(tmp_path.glob("**/*.part"))


def test_include_closure(spark):
    rows = [("a.cpp", '#include "x/b.h"\n'), ("x/b.h", '#include "../c.h"\n#include <none.h>'), ("c.h", '#include "x/b.h"\n'), ("d.cpp", "")]
    got = {(r.path, r.target): r.depth for r in syntax.include_closure(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("a.cpp", "x/b.h"): 1, ("a.cpp", "c.h"): 2, ("x/b.h", "c.h"): 1, ("c.h", "x/b.h"): 1}


def test_suggestions():
    got = suggest.suggest("  foo.bar(1, x == y);\n", "JavaScript")
    by = {s.pattern: s for s in got}
    assert got[0].description == "exact match" and by["$RECV.$METHOD($$$ARGS)"].match_count == 1 and "$A == $B" in by
    assert len(by) == len(got) and suggest.suggest("  ", "Java") == []
    assert suggest.in_full_text("  foo", [(0, 3)]) == [(2, 5)]
    assert suggest.suggest("let x = 1;", "Auto")


def test_explain():
    e = explain.explain("^(foo|bar)+x{2}$")
    assert e.is_valid and e.stats == {"groups": 1, "alternations": 1, "char_classes": 0, "quantifiers": 2}
    assert explain.explain("[a-z][0-9]").stats["char_classes"] == 2
    assert [t.depth for t in explain.tokens("(a|(b))")] == [0, 1, 1, 1, 2, 1, 0]
    tree = explain.explain("(a|b)c").tree.as_dict()
    assert tree["kind"] == "sequence" and tree["children"][0]["children"][0]["kind"] == "alternation"
    assert not explain.explain("(a").is_valid and explain.tokens("(a")[-1].kind == "error"
    assert not explain.explain("(?=a)").is_valid
    assert explain.explain(r"(?P<n>\d+)").tree.children[0].kind == "repeat"
    assert [explain.allows_zero(q) for q in ("*", "+", "?", "{0,3}", "{2}")] == [True, False, True, True, False]
    assert [explain.repeats_more(q) for q in ("*", "+", "?", "{1}", "{2}", "{0,1}", "{1,}")] == [True, True, False, False, True, False, True]
    assert explain.test_matches(" é ", "aéé") == [(1, 3), (3, 5)] and len(explain.test_matches("a", "a" * 500)) == 100


def test_qualified_calls():
    yes, no = ["a::b($X)", " ns::f() "], ["a.b()", "a::b();", "x = a::b()", "if (a::b())", "return a::b()", "a::b() {}"]
    assert all(map(matcher.looks_like_qualified_call, yes)) and not any(map(matcher.looks_like_qualified_call, no))


def test_expressions_are_only_looked_for_where_the_pattern_may_begin(monkeypatch):
    asked, ends = [], matcher.Expressions.ends

    def counted(self, i, level=None):
        asked.append(i)
        return ends(self, i, level)

    source = "class A { void f() { " + "a(1, 2); b.c(3 + 4); " * 50 + "run(5, 5); } }"
    matcher.strategies("run($A, $A)", "Java")
    monkeypatch.setattr(matcher.Expressions, "ends", counted)
    assert [source[h.start : h.end] for h in matcher.find(source, "run($A, $A)", "Java")] == ["run(5, 5)"]
    assert len(asked) < 10


@pytest.mark.parametrize("name", ["m9_same_name_of_all_languages", "m7_calls_of_all_languages", "m7_many_of_all_languages", "x1_rewrite_shapes"])
def test_one_small_file_is_searched_on_all_cores(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    assert queries.table(spark, sf, "customer").rdd.getNumPartitions() == 1
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism * (6 if name.startswith("x1") else 1)
