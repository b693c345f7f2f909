"""Languages, encodings, conditions, command line, file tree, reports, SQL functions, entry points."""

import json
import subprocess
import sys
import zipfile

import pyarrow as pa
import pytest

from lodeseek import cli
from lodeseek.functions import encodings, languages
from lodeseek.operators import filters, search
from lodeseek.plans import conditions as cond
from lodeseek.plans.conditions import PLAIN, PatternJob, SearchConditions


def test_extensions():
    assert {e: languages.from_extension(e) for e in ("rs", "PYI", ".java", "h", "mts", "sbt", "ktm", "hxx")} == {"rs": "Rust", "PYI": "Python", ".java": "Java", "h": "C++", "mts": "TypeScript", "sbt": "Scala", "ktm": "Kotlin", "hxx": "C++"}
    assert languages.from_extension("") is None and languages.from_extension("zzz") is None
    assert languages.from_path("a/b/c.go") == "Go" and languages.from_path("Makefile") is None
    assert languages.from_alias("C++") == "C++" and languages.from_alias("kts") == "Kotlin" and languages.from_alias("auto") is None and languages.from_alias("") is None
    assert sum(map(len, languages.ALIASES.values())) == 25
    auto = languages.extension_mapping("Auto")
    assert auto == sorted(auto) and ("h", "C++") in auto and {"rs", "py"} <= languages.union_extensions()
    assert len(languages.presets("Rust")) == 5 and languages.presets("C#") == [("Any expression", "$EXPR")]
    assert languages.label("Auto") == "Auto (extension)"


def test_decoding():
    e = encodings
    assert e.decode_auto(b"") == e.Decoded("", "Utf8") and e.decode_auto("é".encode()).text == "é"
    assert e.decode_auto(b"\xef\xbb\xbfab") == e.Decoded("ab", "Utf8")
    assert e.decode_auto(b"\xff\xfea\x00") == e.Decoded("a", "Utf16Le") and e.decode_auto(b"\xfe\xff\x00a") == e.Decoded("a", "Utf16Be")
    for raw in (b"\xff\xfe\x00\x00a\x00\x00\x00", b"\x00\x00\xfe\xff"):
        with pytest.raises(e.DecodeError):
            e.decode_auto(raw)
    assert e.without_mark("añbcdefgh".encode("utf-16-le")) == "Utf16Le" and e.without_mark("añbcdefgh".encode("utf-16-be")) == "Utf16Be" and e.without_mark(b"a\x00b\x00") is None
    for name, text in (("ShiftJis", "日本語"), ("EucJp", "日本語"), ("Iso2022Jp", "日本語"), ("Gbk", "汉字"), ("Big5", "漢字"), ("EucKr", "한국"), ("Windows1252", "é"), ("Utf16Le", "aé"), ("Utf16Be", "aé"), ("Utf8", "é😀")):
        raw = e.encode(text, name)
        assert e.decode_as(raw, name).text == text
    assert e.encode("a", "Utf16Le").startswith(b"\xff\xfe") and e.encode("é", "Utf8") == b"\xc3\xa9"
    with pytest.raises(e.DecodeError):
        e.encode("日", "Windows1252")
    with pytest.raises(e.DecodeError):
        e.decode_as(b"\xff\xff", "Utf8")
    assert e.label("Gbk") == "GBK / GB18030" and e.label("detected:koi8-r") == "koi8-r"
    assert e.detail("Utf8") == "Encoding: UTF-8 / Aliases: UTF8, UTF-8N / Near matches: UTF-16 LE, UTF-16 BE"


def test_binary():
    yes, no = ["\0" * 10, "a" * 50 + "\x01" * 5, "�" * 2 + "a" * 100], ["", "prose\r\n\t\f", "a" * 100 + "\x01" * 5]
    assert all(map(encodings.looks_binary, yes)) and not any(map(encodings.looks_binary, no))


def test_binary_in_spark(spark):
    from pyspark.sql import functions as F

    rows = ["\x01" * 10, "a" * 50 + "\x01" * 5, "�" * 2 + "a" * 100, "", "prose\r\n\t\f", "a" * 100 + "\x01" * 5, "a" * 4096 + "\x01" * 500]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").coalesce(1).orderBy("i").select(filters.looks_binary(F.col("t"))).collect()]
    assert got == [encodings.looks_binary(t) for t in rows]


def test_filters(spark):
    from pyspark.sql import functions as F

    paths = ["a/src/x.java", "src/y.py", "z.rs", "target/x/q.rs", "a.b/target", "x.RS", "no"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    pick = lambda c: [r[0] for r in df.where(c).collect()]
    assert pick(filters.not_in_dirs(F.col("path"), " target ;; src")) == ["z.rs", "a.b/target", "x.RS", "no"]
    assert filters.name_matches(F.col("path"), " ; ") is None and filters.name_matches(F.col("path"), "(") is None
    assert pick(filters.name_matches(F.col("path"), "*.java; y.*")) == ["a/src/x.java", "src/y.py"]
    assert pick(filters.name_matches(F.col("path"), "src/*.py")) == []
    assert pick(filters.has_language_extension(F.col("path"), "Auto")) == ["a/src/x.java", "src/y.py", "z.rs", "target/x/q.rs"]
    assert pick(filters.has_language_extension(F.col("path"), "Python")) == ["src/y.py"]


def test_jobs(tmp_path):
    c = SearchConditions("d", "p", search_mode=PLAIN, plain_text_options=cond.PlainTextOptions(True, False))
    jobs = [PatternJob(i, f"j{i}", i != 42, c) for i in (99, 42, 7)]
    again, next_id = cond.jobs_from_yaml(cond.jobs_to_yaml(jobs))
    assert [j.id for j in again] == [1, 2, 3] and next_id == 4 and [j.enabled for j in again] == [True, False, True] and again[0].conditions == c
    assert cond.renumbered([]) == ([], 1)
    with pytest.raises(cond.JobsFileError):
        cond.jobs_from_yaml("version: 9999\njobs: []")
    path = str(tmp_path / "jobs.yaml")
    cond.write_jobs(path, jobs)
    assert cond.read_jobs(path)[1] == 4
    run = lambda p, d, on=True: PatternJob(1, "", on, SearchConditions(d, p)).runnable()
    assert [run("p", "d"), run("p", "d", False), run(" ", "d"), run("p", " ")] == [True, False, False, False]
    assert [j.id for j in cond.move_job(jobs, 0, 1)] == [42, 99, 7] and cond.move_job(jobs, 2, 1) == jobs
    assert cond.add_job([], 5, c)[1] == 6


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    s = cond.Settings.load(path)
    assert s == cond.Settings()
    for i in range(40):
        s.remember(f"p{i}")
    s.remember("p20")
    assert s.history[:2] == ["p20", "p39"] and len(s.history) == 30 and s.suggestions("p2") == ["p20", "p29", "p28", "p27", "p26", "p25", "p24", "p23"]
    s.jobs = [PatternJob(1, "a", True, SearchConditions("d", "p"))]
    s.save(path)
    again = cond.Settings.load(path)
    assert again.history == s.history and again.jobs == s.jobs
    assert SearchConditions(pattern="$RECV.x()").wants_receiver and not SearchConditions(pattern="x").wants_receiver


def test_command_line():
    a = cli.parse_run("sg run -p 'a b' -l rs -C 3 -A 5 src")
    assert a == cli.RunArgs("a b", "Rust", 3, 5, "src") and a.conditions().context_lines == 5 and a.conditions().max_search_hits == 0
    assert cli.parse_run('--pattern "f(\\"x\\")"').pattern == 'f("x")'
    for bad in ("sg run", "-p", "-p x -l nope", "-p x -C y", "-p x --json", "-p 'x"):
        with pytest.raises(cli.CommandError):
            cli.parse_run(bad)
    assert cli.tokenize("a '' b\\ c") == ["a", "b c"]
    assert [cli.is_search_command(x) for x in ("sg", "sg run", "-p x", "--pattern x", "ls", "sgx")] == [True, True, True, True, False, False]
    assert cli.change_dir("/a", "cd b") == "/a/b" and cli.change_dir("/a", "cd /c") == "/c" and cli.change_dir("/a", "ls") is None


@pytest.fixture
def root(tmp_path):
    for name, raw in {"a.py": b"x.go(1)\n", "pkg/__init__.py": b"x.go(2)", "_own/b.py": "é x".encode("utf-16"), ".git/c.py": b"x.go(3)", "node_modules/d.py": b"x.go(4)", "bin.py": b"\x00\x01" * 50, ".hidden.py": b"x", "jis.txt": "日本語 x".encode("cp932")}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    return str(tmp_path / "root")


def test_tree(spark, root):
    from lodeseek.sources import tree

    assert sorted(r.path for r in tree.scan(spark, root, "node_modules").collect()) == ["_own/b.py", "a.py", "bin.py", "jis.txt", "pkg/__init__.py"]
    assert sorted(r.path for r in tree.scan(spark, root, "", 7).collect()) == ["node_modules/d.py", "pkg/__init__.py"]
    spark.dataSource.register(tree.TreeSource)
    by_source = spark.read.format("file_tree").option("skipDirs", "node_modules").load(root)
    rows = lambda df: sorted(tuple(r) for r in df.select("path", "length", "content").collect())
    assert rows(by_source) == rows(tree.scan(spark, root, "node_modules")) == rows(tree.scan(spark, f"file://{root}", "node_modules"))
    assert tree.scan(spark, f"{root}/nowhere").count() == 0
    c = SearchConditions(root, "x", search_mode=PLAIN)
    got = {r.path: (r.text, r.text_encoding) for r in tree.files(spark, c).collect()}
    assert got["_own/b.py"] == ("é x", "Utf16Le") and got["a.py"][1] == "Utf8" and "bin.py" not in got and "jis.txt" in got
    assert search.search(tree.files(spark, c), c).count() == 4


def test_reports(spark, root, tmp_path):
    from lodeseek.sinks import report
    from lodeseek.sources import tree

    c = SearchConditions(root, "$RECV.go($N)", "Python")
    hits, stats = search.run_one(tree.files(spark, c), c)
    assert stats["total_matches"] == 2 and stats["scanned"] == 3
    files = report.collected(hits)
    text = report.text(files, stats, c)
    assert "## a.py\n  line 1:0 \n  x.go(1)\n" in text and "Total: 2 matches / 2 files" in text and text.count("\n- ") == 11
    md = report.markdown(files, stats, c)
    assert "| `a.py` | 1 | 0 | x.go(1) | x.go(1) |  |\n" in md and "|---|---|---|---|---|---|\n" in md
    page = report.html([files[0] | {"relative_path": "<a>&"}], stats | {"hit_limit_reached": True}, c)
    assert "&lt;a&gt;&amp;" in page and "(truncated at hit limit)" in page
    d = json.loads(report.as_json(files, stats, c))
    assert set(d) == {"search", "stats", "results"} and set(d["stats"]) == {"total_matches", "total_files", "elapsed_ms", "hit_limit_reached"} and "recv_type_hint" not in d["results"][0]["matches"][0]
    streamed = lambda kind: "".join(report.parts(kind, hits, stats, c))
    assert (streamed("txt"), streamed("md"), streamed("html")) == (text, md, report.html(files, stats, c)) and json.loads(streamed("json")) == d
    assert "".join(r.block for r in search.ordered(report.blocks(hits, "terminal", c)).collect()).rstrip("\n").split("\n") == cli.rendered(files, stats)[:-2]
    for ext in ("txt", "md", "html", "json", "xlsx"):
        report.save(str(tmp_path / f"r.{ext}"), hits, stats, c)
    assert {"xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"} <= set(zipfile.ZipFile(tmp_path / "r.xlsx").namelist())
    jobs = [PatternJob(1, "go: x", True, c), PatternJob(2, "bad", True, SearchConditions(root, "(", search_mode="Regex"))]
    batch = search.run_batch(lambda x: tree.files(spark, x), jobs)
    for ext in ("txt", "md", "html", "json", "xlsx"):
        report.save_batch(str(tmp_path / f"b.{ext}"), batch)
    assert "ERROR" in (tmp_path / "b.txt").read_text() and "error" in json.loads((tmp_path / "b.json").read_text())["runs"][1]
    assert 'name="01_go_ x_1"' in zipfile.ZipFile(tmp_path / "b.xlsx").read("xl/workbook.xml").decode()
    lines = cli.rendered(files, stats)
    assert lines[0] == "_own/b.py" or lines[0] == "a.py"
    report.hits_as_json(hits, str(tmp_path / "nested"))
    assert spark.read.json(str(tmp_path / "nested")).count() == 2


def test_cells():
    from lodeseek.sinks.report import cell_text, markdown_separator, sheet_name

    assert [len(cell_text("a" * n)) for n in (5, 32_000, 32_001)] == [5, 32_000, 32_000]
    assert len(cell_text("a" + "é" * 20_000).encode()) == 31_999
    assert [markdown_separator(n) for n in (0, 1, 3)] == ["||\n", "|---|\n", "|---|---|---|\n"]
    assert sheet_name("a[b]*?:/\\c" + "x" * 40, 1) == "a_b______c" + "x" * 21 and sheet_name("", 3) == "job_3"


def test_sql_functions(spark):
    from lodeseek.sql import register

    register(spark)
    spark.createDataFrame([(1, "a b\nab")], "id int, text string").createOrReplaceTempView("t_docs")
    q = lambda s: [tuple(r) for r in spark.sql(s).collect()]
    assert q("SELECT h.* FROM t_docs, LATERAL search_plain(text, 'b') h") == [(1, 2, 1, 3, "b"), (2, 1, 2, 2, "b")]
    assert q("SELECT h.matched_text FROM t_docs, LATERAL search_regex(text, 'b\\\\s*a') h") == [("b\na",)]
    assert q("SELECT h.matched_text FROM t_docs, LATERAL search_token(text, 'a b') h") == [("a b",), ("ab",)]
    assert q("SELECT h.matched_text FROM LATERAL search_syntax('f(1); g(2)', '$F(2)', 'Java') h") == [("g(2)",)]
    assert q("SELECT kind FROM regex_tokens('a|b')") == [("literal",), ("alternation",), ("literal",)]
    assert q("SELECT rewrite_syntax('f(1)', 'f($A)', 'g($A)', 'Python'), decode_auto(X'EFBBBF61')") == [("g(1)", "a")]


def test_entry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert e.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "lodeseek", tmp_path / "lodeseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm1_plain' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_decoding_sends_small_batches_to_python(spark):
    """Files of one partition reach a worker 2 MB at a time; with a mark or without one, they are read as the plain function reads them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        mark, text = b"\xef\xbb\xbf", "é日本語\n" * 20_000
        raws = {i: b"\xfe\xff" + (text + str(i)).encode("utf-16-be") for i in range(40)}
        raws |= {100: mark + b"a", 101: mark + mark + b"b", 102: mark, 103: mark + b"\xff", 104: b"", 105: None, 106: mark + b"\x01\x02", 107: b"\x00\x00\xfe\xff\x00\x00\x00a", 108: b"\xff\xfe\x00\x00a\x00\x00\x00", 109: b"\xfe\xff\xd8\x00", 110: b"caf\xe9"}
        files = spark.createDataFrame([(i, r) for i, r in raws.items()], "id int, content binary").coalesce(1)
        found = encodings.decoded(files)
        want = {}
        for i, r in raws.items():
            try:
                d = encodings.decode(r) if r is not None else None
            except encodings.DecodeError:
                d = None
            if d is not None:
                want[i] = (d.text, d.encoding)
        assert {r.id: (r.text, r.text_encoding) for r in found.collect()} == want and len(want) >= 44
        sizes = files.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) < 4 << 20 and sum(r.n for r in sizes) > 6 << 20
        marked = encodings.decoded(files.where("hex(substring(content, 1, 3)) = 'EFBBBF' AND is_valid_utf8(CAST(content AS STRING))"))
        assert marked.count() == 3
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
