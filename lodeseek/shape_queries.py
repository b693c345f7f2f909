"""Registered queries over written-out shapes of source, bytes and commands, set into growing tables; expectations are written out in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search
from .plans import conditions
from .plans.conditions import PLAIN, SearchConditions
from .queries import _LINES_SQL, _TREE_SQL, _line_hits_sql, query, table, tree
from .sinks import report
from .sources.tables import spread


def _quoted(*values: object) -> str:
    return ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in values)


def _shaped(rows: DataFrame, key: str, shapes: list[tuple[str, str]], *values: str) -> DataFrame:
    """files(path, text): to each row the shape of its key's remainder, with the values printed into it. On all cores, as syntax takes long and tables may be one file."""
    rows = spread(rows.select(key, *values))
    ext = F.element_at(F.array(*[F.lit(e) for e, _ in shapes]), (F.col(key) % len(shapes) + 1).cast("int"))
    text = F.coalesce(*[F.when(F.col(key) % len(shapes) == i, F.format_string(t, *values)) for i, (_, t) in enumerate(shapes)])
    return rows.select(F.concat(F.col(key).cast("string"), F.lit("."), ext).alias("path"), text.alias("text"))


def _keyed() -> Column:
    return F.substring_index("path", ".", 1).cast("long")


# ---------------------------------------------------------------- receivers of every language (r1 to r11)

#: Source with the receiver's type, the receiver, and the hint; the number stands for the customer's nation.
RECEIVERS = [
    ("rs", "impl Go for Type%1$d {{ fn x(&self) {{ self.go(1); }} }}", "self", "Type%"),
    ("rs", "fn f() {{ let v: Type%1$d = z(); v.go(1); }}", "v", "Type%"),
    ("go", "func (r *Type%1$d) Get() {{ r.go(1) }}", "r", "*Type%"),
    ("java", "class A {{ void f(java.util.List<Type%1$d> xs) {{ for (Type%1$d x : xs) {{ x.go(1); }} }} }}", "x", "Type%"),
    ("java", "class A {{ Type%1$d held; void f() {{ held.go(1); }} }}", "held", "Type%"),
    ("cs", "class A {{ void G() {{ Type%1$d b = new Type%1$d(); b.go(1); }} }}", "b", "Type%"),
    ("ts", "class A {{ m() {{ const b: Type%1$d = q(); b.go(1); }} }}", "b", "Type%"),
    ("ts", "class Type%1$d {{ m() {{ this.go(1); }} }}", "this", "Type%"),
    ("cpp", "void f(const Type%1$d & s) {{ s.go(1); }}", "s", "const Type% &"),
    ("cpp", "class A {{ Type%1$d m_b; void f() {{ m_b.go(1); }} }};", "m_b", "Type%"),
    ("py", "class Type%1$d:\n    def f(self):\n        self.go(1)\n", "self", "Type%"),
    ("kt", "class Type%1$d {{ fun f() {{ this.go(1) }} }}", "this", "Type%"),
    ("scala", "object Type%1$d {{ def f() = {{ this.go(1) }} }}", "this", "Type%"),
    ("c", "void f() {{ Type%1$d a; a.go(1); }}", "a", None),
]
_RECEIVER_ROWS = ", ".join(f"({_quoted(i, r, h)})" for i, (_, _, r, h) in enumerate(RECEIVERS))


@query("r_receivers", f"""SELECT c_custkey AS id, receiver || '.go(1)' AS matched_text, replace(hint, 'Type%', 'Type' || c_nationkey) AS hint
FROM customer JOIN (VALUES {_RECEIVER_ROWS}) AS t(i, receiver, hint) ON c_custkey % {len(RECEIVERS)} = i""")
def _receivers(spark, sf_dir):
    shapes = [(e, t.replace("{{", "{").replace("}}", "}")) for e, t, _, _ in RECEIVERS]
    files = _shaped(table(spark, sf_dir, "customer"), "c_custkey", shapes, "c_nationkey")
    hits = search.search(files, SearchConditions("customers", "$RECV.go($A)"))
    return hits.select(_keyed().alias("id"), "matched_text", F.col("recv_type_hint").alias("hint"))


@query("r7_headers", "SELECT s_suppkey AS id, 'Thing' || s_nationkey AS hint FROM supplier")
def _headers(spark, sf_dir):
    """Members declared in a header that a header takes in."""
    s = table(spark, sf_dir, "supplier")
    of = lambda path, text: s.select(F.format_string(path, "s_suppkey").alias("path"), F.format_string(text, "s_suppkey", "s_nationkey").alias("text"))
    files = of("%d.cpp", '#include "inc/a%1$d.h"\nvoid Foo::bar() { m_x.go(1); }').union(of("inc/a%d.h", '#include "b%1$d.h"\n')).union(of("inc/b%d.h", "class Foo { Thing%2$d m_x; };"))
    hits = search.search(files, SearchConditions("suppliers", "$RECV.go($A)", "C++"))
    return hits.select(_keyed().alias("id"), F.col("recv_type_hint").alias("hint"))


@query("j11_closure", "SELECT s_suppkey || '.cpp' AS path, t.target || s_suppkey || '.h' AS target, depth FROM supplier, (VALUES ('inc/a', 1), ('inc/b', 2)) AS t(target, depth) UNION ALL SELECT 'inc/a' || s_suppkey || '.h', 'inc/b' || s_suppkey || '.h', 1 FROM supplier")
def _closure(spark, sf_dir):
    """What each file takes in, and how deep; headers that take in one another end."""
    from .operators.syntax import spark as syntax

    s = table(spark, sf_dir, "supplier")
    of = lambda path, text: s.select(F.format_string(path, "s_suppkey").alias("path"), F.format_string(text, "s_suppkey").alias("text"))
    files = of("%d.cpp", '#include "inc/a%d.h"\n').union(of("inc/a%d.h", '#include "b%d.h"\n')).union(of("inc/b%d.h", '#include <none.h>\n#include "b%d.h"\n'))
    return syntax.include_closure(files).select("path", "target", "depth")


# ---------------------------------------------------------------- the same pattern in every language (m7, m9)

#: Source of a call of two arguments.
CALLS = [
    ("rs", "fn f() { let a = 1; run(%d, %d); }"),
    ("java", "class A { void f() { run(%d, %d); } }"),
    ("py", "def f():\n    run(%d, %d)\n"),
    ("js", "function f() { run(%d, %d) }"),
    ("ts", "const f = (): void => { run(%d, %d); };"),
    ("go", "func f() {\n\trun(%d, %d)\n}"),
    ("cpp", "void A::f() { run(%d, %d); }"),
    ("c", "int main(void) { run(%d, %d); return 0; }"),
    ("cs", "class A { void F() { run(%d, %d); } }"),
    ("kt", "fun f() {\n    run(%d, %d)\n}"),
    ("scala", "object A { def f() = run(%d, %d) }"),
]


def _calls(spark, sf_dir, pattern: str) -> DataFrame:
    files = _shaped(table(spark, sf_dir, "customer").withColumn("other", F.col("c_custkey") % 10), "c_custkey", CALLS, "c_nationkey", "other")
    hits = search.search(files, SearchConditions("customers", pattern))
    return hits.select(_keyed().alias("id"), "source_language", "matched_text")


_CALL_LANGUAGES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(("Rust", "Java", "Python", "JavaScript", "TypeScript", "Go", "C++", "C", "C#", "Kotlin", "Scala")))
_CALL_SQL = f"SELECT c_custkey AS id, lang AS source_language, 'run(' || c_nationkey || ', ' || c_custkey % 10 || ')' AS matched_text FROM customer JOIN (VALUES {_CALL_LANGUAGES}) AS t(i, lang) ON c_custkey % 11 = i"
query("m7_calls_of_all_languages", _CALL_SQL)(lambda s, d: _calls(s, d, "run($A, $B)"))
query("m7_many_of_all_languages", _CALL_SQL)(lambda s, d: _calls(s, d, "run($$$ARGS)"))
query("m9_same_name_of_all_languages", _CALL_SQL + " WHERE c_nationkey = c_custkey % 10")(lambda s, d: _calls(s, d, "run($A, $A)"))


# ---------------------------------------------------------------- rewriting (x1, x2, a7, a8)

#: Language, text, pattern, template, text after, replacements; @ stands for the customer's nation.
REWRITES = [
    ("Python", "print(@1); print(2)", "print($X)", "log($X)", "log(@1); log(2)", 2),
    ("Rust", "let a = b@.unwrap();", "$V.unwrap()", '$V.expect("x")', 'let a = b@.expect("x");', 1),
    ("Python", "f(f(@))", "f($A)", "g($A)", "g(g(@))", 2),
    ("Java", "a(1, @)", "a($$$X)", "b($$$X)", "b(1, @)", 1),
    ("JavaScript", "x == y@", "$A == $B", "$A === $B", "x === y@", 1),
    ("C++", "p->go(@);", "$P->go($A)", "$P->come($A)", "p->come(@);", 1),
]


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({_quoted(*r)})" for r in rows)


@query("x1_rewrite_shapes", f"SELECT c_custkey AS id, replace(b, '@', '' || c_nationkey) AS before_, replace(a, '@', '' || c_nationkey) AS after_, n AS replacements FROM customer JOIN (VALUES {_values([(i, t, a, n) for i, (_, t, _, _, a, n) in enumerate(REWRITES)])}) AS t(i, b, a, n) ON c_custkey % {len(REWRITES)} = i")
def _rewrites(spark, sf_dir):
    """Rewrites in several languages; each customer's text takes one of them."""
    from .operators.syntax import spark as syntax

    customers, out = spread(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))), None
    for i, (lang, text, pattern, template, _, _) in enumerate(REWRITES):
        files = customers.where(F.col("c_custkey") % len(REWRITES) == i).select(F.col("c_custkey").cast("string").alias("path"), F.lit(lang).alias("source_language"), F.replace(F.lit(text), F.lit("@"), "nation").alias("text"))
        one = syntax.rewritten(files, pattern, template, lang).select(F.col("path").cast("long").alias("id"), F.col("before").alias("before_"), F.col("after").alias("after_"), "replacements")
        out = one if out is None else out.unionByName(one)
    return out


@query("x3_write_back", "SELECT n_nationkey || '.py' AS path, CAST(NULL AS VARCHAR) AS error FROM nation UNION ALL SELECT '../' || n_nationkey || '.py', '../' || n_nationkey || '.py leads out of the folder' FROM nation")
def _write_back(spark, sf_dir):
    """Files written below a folder, and paths that lead out of it."""
    from .cluster import checkpoint_folder
    from .operators.syntax import spark as syntax

    n = table(spark, sf_dir, "nation")
    paths = [F.format_string(p, "n_nationkey").alias("path") for p in ("%d.py", "../%d.py")]
    preview = n.select(paths[0], F.col("n_name").alias("after")).union(n.select(paths[1], "n_name"))
    return syntax.write_back(preview, f"{checkpoint_folder(spark).removeprefix('file:')}/written")


# ---------------------------------------------------------------- decoding (d2 to d5, d7)

#: Preference, bytes, text and the encoding told; null where the bytes are no text in it.
BYTES = [
    ("Auto", "FFFE6100E9006200", "aéb", "Utf16Le"),
    ("Auto", "FEFF006100E90062", "aéb", "Utf16Be"),
    ("Auto", "EFBBBFC3A9", "é", "Utf8"),
    ("Auto", "0000FEFF00000061", None, None),
    ("Auto", "FFFE000061000000", None, None),
    ("Auto", "6100F100620063006400650066006700", "añbcdefg", "Utf16Le"),
    ("Auto", "006100F1006200630064006500660067", "añbcdefg", "Utf16Be"),
    ("ShiftJis", "93FA967B8CEA", "日本語", "ShiftJis"),
    ("EucJp", "C6FCCBDCB8EC", "日本語", "EucJp"),
    ("Iso2022Jp", "1B2442467C4B5C386C1B2842", "日本語", "Iso2022Jp"),
    ("Gbk", "D6D0CEC4", "中文", "Gbk"),
    ("Big5", "A4A4A4E5", "中文", "Big5"),
    ("EucKr", "C7D1B1B9", "한국", "EucKr"),
    ("Windows1252", "636166E9", "café", "Windows1252"),
    ("Utf16Le", "6100E900", "aé", "Utf16Le"),
    ("Utf16Be", "006100E9", "aé", "Utf16Be"),
    ("Utf8", "FFFF", None, None),
]


def _shape(key: str, of: list) -> Column:
    """The column of the shape of a key's remainder."""
    return F.coalesce(*[F.when(F.col(key) % len(of) == i, x) for i, x in enumerate(of)])


_BYTES_SQL = f"customer JOIN (VALUES {_values([(i, *x) for i, x in enumerate(BYTES)])}) AS t(i, preference, bytes, told, encoding) ON c_custkey % {len(BYTES)} = i"


@query("d5_decode_shapes", f"SELECT c_custkey AS id, told || c_nationkey AS text, encoding AS text_encoding FROM {_BYTES_SQL} WHERE told IS NOT NULL")
def _decode(spark, sf_dir):
    """Bytes of every encoding with a number behind, by the encoding told or found; what is no text is left out."""
    from .functions import encodings

    charset = {"Utf16Le": "UTF-16LE", "Utf16Be": "UTF-16BE"}
    number = F.col("c_nationkey").cast("string")
    content = _shape("c_custkey", [F.concat(F.unhex(F.lit(b)), F.encode(number, charset.get(e, "US-ASCII"))) for _, b, _, e in BYTES])
    files, out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), content.alias("content")), None
    for preference in dict.fromkeys(p for p, *_ in BYTES):
        these = [i for i, x in enumerate(BYTES) if x[0] == preference]
        one = encodings.decoded(files.where((F.col("id") % len(BYTES)).isin(these)), preference).select("id", "text", "text_encoding")
        out = one if out is None else out.unionByName(one)
    return out


@query("d7_encode_shapes", f"SELECT c_custkey AS id, preference AS encoding, CASE WHEN told IS NOT NULL THEN bytes || hex('' || c_nationkey) END AS bytes FROM {_BYTES_SQL} WHERE preference NOT IN ('Auto', 'Utf16Le', 'Utf16Be')")
def _encode(spark, sf_dir):
    """Texts in every encoding but the wide ones, with a number behind."""
    from .functions import encodings

    number = F.col("c_nationkey").cast("string")
    text = _shape("c_custkey", [F.concat(F.lit(t), number) for _, _, t, _ in BYTES])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _shape("c_custkey", [F.lit(p) for p, *_ in BYTES]).alias("encoding"), text.alias("text"))
    return rows.where("encoding NOT IN ('Auto', 'Utf16Le', 'Utf16Be')").select("id", "encoding", F.hex(encodings.encoded(F.col("text"), F.col("encoding"))).alias("bytes"))


# ---------------------------------------------------------------- trees of files (s1, s2, f5), written in their encodings (x3, x6)

FOLDERS = ["a", "a/b", "skipped/c", "_own/deep/er"]
_FILES_SQL = f"""(SELECT folder || '/' || c_custkey || '.txt' AS path, bytes || hex('' || c_nationkey) AS content
FROM {_BYTES_SQL} JOIN (VALUES {_values(list(enumerate(FOLDERS)))}) AS f(k, folder) ON c_custkey % {len(FOLDERS)} = k
WHERE told IS NOT NULL AND preference NOT IN ('Auto', 'Utf16Le', 'Utf16Be'))"""


def _written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a tree with a file for each customer, in one of nine encodings."""
    from .cluster import checkpoint_folder
    from .operators.syntax import spark as syntax

    root = f"{checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"
    path = F.concat(_shape("c_custkey", [F.lit(x) for x in FOLDERS]), F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".txt"))
    text = _shape("c_custkey", [F.concat(F.lit(t), F.col("c_nationkey").cast("string")) for _, _, t, _ in BYTES])
    rows = table(spark, sf_dir, "customer").select(path.alias("path"), text.alias("after"), _shape("c_custkey", [F.lit(p) for p, *_ in BYTES]).alias("text_encoding"))
    rows = rows.where("after IS NOT NULL AND text_encoding NOT IN ('Auto', 'Utf16Le', 'Utf16Be')")
    syntax.write_back(rows, f"{root.removeprefix('file:')}/tree").write.parquet(f"{root}/errors")
    return f"{root}/tree"


@query("x6_encodings", f"SELECT path, content FROM {_FILES_SQL}")
def _encodings(spark, sf_dir):
    """What stands in files that were written back, each in the encoding that was recorded for it."""
    from .sources import tree as files

    return files.scan(spark, _written_tree(spark, sf_dir)).select("path", F.hex("content").alias("content"))


@query("s1_tree", f"SELECT path, len(content) // 2 AS length FROM {_FILES_SQL} WHERE path NOT LIKE 'skipped/%' AND len(content) <= 16")
def _tree(spark, sf_dir):
    """A listing by levels on executors, without a skipped folder and files over 8 bytes."""
    from .sources import tree as files

    return files.scan(spark, _written_tree(spark, sf_dir), "skipped", 8).select("path", "length")


# ---------------------------------------------------------------- reports (k1 to k4) and rendering (p13)

_REPORT_SQL = f"""WITH {_LINES_SQL}, {_TREE_SQL}, h AS (
  SELECT t.path, l.doc_id, CAST(line_no AS INT) AS line_start, CAST(strlen(split_part(line, 'worthless', 1)) AS INT) AS col_start, line,
         rtrim(array_to_string(list_concat(d.ls[greatest(1, line_no - 1):line_no - 1], [line], d.ls[line_no + 1:line_no + 1]), chr(10)), chr(10)) AS shown,
         d.ls[greatest(1, line_no - 1):line_no - 1] AS before_, d.ls[line_no + 1:line_no + 1] AS after_,
         row_number() OVER (PARTITION BY path ORDER BY line_no) AS n, count(*) OVER (PARTITION BY path) AS of
  FROM lines l JOIN tree t USING (doc_id) JOIN lined d USING (doc_id) WHERE contains(line, 'worthless') AND len(string_split(line, 'worthless')) = 2)
"""
_HTML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
#: What each kind of report says of a hit, in SQL.
_BLOCK_SQL = {
    "txt": "CASE WHEN n = 1 THEN '## ' || path || chr(10) ELSE '' END || '  line ' || line_start || ':' || col_start || ' ' || chr(10) || '  ' || replace(shown, chr(10), chr(10) || '  ') || chr(10) || CASE WHEN n = of THEN chr(10) ELSE '' END",
    "md": "'| `' || path || '` | ' || line_start || ' | ' || col_start || ' | worthless | ' || replace(replace(shown, '|', chr(92) || '|'), chr(10), '<br>') || ' |' || chr(10)",
    "html": f"'<tr>' || chr(10) || '<td><code>' || path || '</code></td>' || chr(10) || '<td>' || line_start || '</td>' || chr(10) || '<td>' || col_start || '</td>' || chr(10) || '<td><code>worthless</code></td>' || chr(10) || '<td><code>' || replace({_HTML.format('shown')}, chr(10), '<br>' || chr(10)) || '</code></td>' || chr(10) || '</tr>' || chr(10)",
    "terminal": "CASE WHEN n = 1 THEN path || chr(10) ELSE '' END || array_to_string(list_concat(list_transform(before_, lambda x: '  ' || lpad('' || (line_start - 1), 5, ' ') || ' | ' || x), ['> ' || lpad('' || line_start, 5, ' ') || ' | ' || line], list_transform(after_, lambda x: '  ' || lpad('' || (line_start + 1), 5, ' ') || ' | ' || x)), chr(10)) || chr(10) || chr(10)",
}
_KIND_NAMES = {"txt": "k1_text", "md": "k2_markdown", "html": "k3_html", "terminal": "p13_terminal"}


def _report_blocks(kind: str):
    def run(spark, sf_dir):
        c = SearchConditions("documents", "worthless", search_mode=PLAIN, context_lines=1)
        hits = search.search(tree(spark, sf_dir), c)
        # lines with one hit: the SQL finds the first
        once = hits.withColumn("in_line", F.size(F.split("span_lines_text", "worthless", -1))).where("in_line = 2")
        return report.blocks(once, kind, c).select("path", "line_start", "block")

    return run


for _kind, _name in _KIND_NAMES.items():
    query(_name, f"{_REPORT_SQL} SELECT path, line_start, {_BLOCK_SQL[_kind]} AS block FROM h")(_report_blocks(_kind))


@query("k4_json", f"""WITH {_LINES_SQL}, {_TREE_SQL}, h AS ({_line_hits_sql("worthless")})
SELECT path, array_to_string(list('worthless@' || line_start || ':' || col_start || '-' || line_end || ':' || col_end ORDER BY line_start, col_start), ' ') AS told, path AS relative_path, 'UTF-8' AS text_encoding
FROM h JOIN tree USING (doc_id) GROUP BY path""")
def _k4(spark, sf_dir):
    """The JSON of each file, read again."""
    each = report.file_objects(search.search(tree(spark, sf_dir), SearchConditions("documents", "worthless", search_mode=PLAIN)))
    hit = "struct<matched_text:string,line_start:int,col_start:int,line_end:int,col_end:int>"
    back = each.select(F.from_json("json", f"path string, relative_path string, text_encoding string, matches array<{hit}>").alias("f"))
    said = F.transform("f.matches", lambda h: F.format_string("%s@%d:%d-%d:%d", h["matched_text"], h["line_start"], h["col_start"], h["line_end"], h["col_end"]))
    return back.select("f.path", F.array_join(said, " ").alias("told"), "f.relative_path", "f.text_encoding")


# ---------------------------------------------------------------- commands (p10 to p12) and quantifiers (p7 to p9)

#: Command line, then pattern, language, lines before and after, folder; or the error. @ stands for the customer's nation.
COMMANDS = [
    ("sg run -p 'a b@' -l rs -C 2 src", "a b@", "Rust", 2, 2, "src", None),
    ("-p x@", "x@", "Auto", 0, 0, "", None),
    ("sg -p x -A 3 -B 1 d@", "x", "Auto", 1, 3, "d@", None),
    ('run --pattern "f($X)" --lang python', "f($X)", "Python", 0, 0, "", None),
    ("sg -l nope@ -p x", None, None, None, None, None, "unknown language nope@"),
    ("sg -C two -p x", None, None, None, None, None, "-C needs a number"),
    ("sg run src@", None, None, None, None, None, "no pattern: give -p or --pattern"),
]


@query("p10_commands", f"SELECT c_custkey AS id, replace(p, '@', '' || c_nationkey) AS pattern, l AS lang, b AS before_, a AS after_, replace(d, '@', '' || c_nationkey) AS folder, replace(e, '@', '' || c_nationkey) AS error FROM customer JOIN (VALUES {_values([(i, *c[1:]) for i, c in enumerate(COMMANDS)])}) AS t(i, p, l, b, a, d, e) ON c_custkey % {len(COMMANDS)} = i")
def _commands(spark, sf_dir):
    from . import cli

    line = F.replace(_shape("c_custkey", [F.lit(c) for c, *_ in COMMANDS]), F.lit("@"), F.col("c_nationkey").cast("string"))
    read = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cli.parsed(line).alias("r"))
    return read.select("id", "r.pattern", "r.lang", F.col("r.context_before").alias("before_"), F.col("r.context_after").alias("after_"), F.col("r.search_dir").alias("folder"), "r.error")


@query("p8_quantifiers", """WITH q AS (SELECT c_custkey AS id, c_nationkey AS lo, c_nationkey + c_custkey % 3 AS hi, c_custkey % 7 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN '*' WHEN 1 THEN '+?' WHEN 2 THEN '?' WHEN 3 THEN '{' || lo || '}' WHEN 4 THEN '{' || lo || ',}' ELSE '{' || lo || ',' || hi || '}' || CASE WHEN k = 5 THEN '' ELSE '?' END END AS quantifier,
 CASE WHEN k < 3 THEN k <> 1 ELSE lo = 0 END AS zero, CASE k WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN lo > 1 WHEN 4 THEN TRUE ELSE hi > 1 END AS more FROM q""")
def _quantifiers(spark, sf_dir):
    from .operators import explain

    lo, hi = F.col("c_nationkey").cast("string"), (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("string")
    shapes = [F.lit("*"), F.lit("+?"), F.lit("?"), F.concat(F.lit("{"), lo, F.lit("}")), F.concat(F.lit("{"), lo, F.lit(",}")), F.concat(F.lit("{"), lo, F.lit(","), hi, F.lit("}")), F.concat(F.lit("{"), lo, F.lit(","), hi, F.lit("}?"))]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _shape("c_custkey", shapes).alias("quantifier"))
    zero, more = explain.quantifier_says(F.col("quantifier"))
    return rows.select("id", "quantifier", zero.alias("zero"), more.alias("more"))


@query("p9_test_matches", """WITH cut AS (SELECT c_custkey AS id, regexp_split_to_array('é' || c_nationkey || 'x' || c_name, '[0-9]+') AS g, regexp_extract_all('é' || c_nationkey || 'x' || c_name, '[0-9]+') AS m FROM customer),
hit AS (SELECT id, g, m, unnest(generate_series(1, len(m))) AS k FROM cut), h AS (SELECT id, m[k] AS m, array_to_string(list_transform(generate_series(1, k), lambda i: g[i] || CASE WHEN i < k THEN m[i] ELSE '' END), '') AS head FROM hit)
SELECT id, CAST(strlen(head) AS INT) AS start_, CAST(strlen(head) + strlen(m) AS INT) AS end_ FROM h""")
def _test_matches(spark, sf_dir):
    from .operators import explain

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("é"), F.col("c_nationkey").cast("string"), F.lit("x"), "c_name").alias("text"))
    found = rows.select("id", F.explode(explain.test_hits(F.col("text"), F.lit(" [0-9]+ "))).alias("m"))
    return found.select("id", F.col("m.start").alias("start_"), F.col("m.end").alias("end_"))


#: Parts of the pattern ^(ab@|[0-9]+){2}$ with their kinds and depths.
TOKENS = [(0, "anchor", "^", 0), (1, "group", "(", 0), (2, "literal", "ab@", 1), (3, "alternation", "|", 1), (4, "class", "[0-9]", 1), (5, "quantifier", "+", 1), (6, "group_end", ")", 0), (7, "quantifier", "{2}", 0), (8, "anchor", "$", 0)]


@query("p6_regex_tokens", f"SELECT c_custkey AS id, no, kind, replace(token, '@', '' || c_nationkey) AS token, depth FROM customer, (VALUES {_values(TOKENS)}) AS t(no, kind, token, depth)")
def _p6(spark, sf_dir):
    from .sql import register

    register(spark)
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string("^(ab%d|[0-9]+){2}$", "c_nationkey").alias("pattern")).createOrReplaceTempView("typed_patterns")
    return spark.sql("SELECT c.id, t.no, t.kind, t.token, t.depth FROM typed_patterns c, LATERAL regex_tokens(c.pattern) t")


# ---------------------------------------------------------------- dimensions met by rows (d8, p5, w7, u1, f6, f13)

_LABEL_SQL = """(VALUES (0,'Utf8','UTF-8','UTF8, UTF-8N','UTF-16 LE, UTF-16 BE'), (1,'Utf16Le','UTF-16 LE','UTF-16, Unicode','UTF-8, Shift_JIS (CP932)'), (2,'Utf16Be','UTF-16 BE','UTF-16, Unicode','UTF-8, Shift_JIS (CP932)'),
(3,'ShiftJis','Shift_JIS (CP932)','CP932, Windows-31J, MS_Kanji','EUC-JP, JIS (ISO-2022-JP)'), (4,'EucJp','EUC-JP','EUC','Shift_JIS (CP932), JIS (ISO-2022-JP)'), (5,'Iso2022Jp','JIS (ISO-2022-JP)','JIS','Shift_JIS (CP932), EUC-JP'),
(6,'Gbk','GBK / GB18030','GB18030, CP936','Big5, Latin1 / Windows-1252'), (7,'Big5','Big5','CP950','GBK / GB18030, Latin1 / Windows-1252'), (8,'EucKr','EUC-KR','KS X 1001, CP949','Latin1 / Windows-1252, UTF-8'),
(9,'Windows1252','Latin1 / Windows-1252','Latin1, ISO-8859-1','UTF-8, Shift_JIS (CP932)')) AS t(i, encoding, label, aliases, near)"""
_NAMES = ["Utf8", "Utf16Le", "Utf16Be", "ShiftJis", "EucJp", "Iso2022Jp", "Gbk", "Big5", "EucKr", "Windows1252"]


@query("d8_labels", f"SELECT c_custkey AS id, encoding, label, aliases, near FROM customer JOIN {_LABEL_SQL} ON c_custkey % 10 = i")
def _d8(spark, sf_dir):
    """The labels of the encoding that each customer prefers."""
    from .functions import encodings

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _shape("c_custkey", [F.lit(n) for n in _NAMES]).alias("encoding"))
    # a row for each encoding
    return rows.join(F.broadcast(encodings.dimension(spark)), "encoding")


@query("p5_presets", """SELECT c_custkey AS id, lang, no, pattern FROM customer JOIN (VALUES
 (0, 'Rust', 0, 'fn $NAME($$$ARGS)'), (0, 'Rust', 1, 'impl $TRAIT for $TYPE'), (0, 'Rust', 2, '$VAR.unwrap()'), (0, 'Rust', 3, '$VAR.clone()'), (0, 'Rust', 4, 'panic!($$$ARGS)'),
 (1, 'Java', 0, '$VAR == null'), (1, 'Java', 1, 'System.out.println($$$ARGS)'), (2, 'Python', 0, 'print($$$ARGS)'), (2, 'Python', 1, 'import $MODULE'),
 (3, 'JavaScript', 0, 'console.log($$$ARGS)'), (4, 'TypeScript', 0, 'console.log($$$ARGS)'), (5, 'Go', 0, 'if err != nil { $$$BODY }'), (6, 'C++', 0, '$EXPR'), (7, 'C', 0, '$EXPR'), (8, 'C#', 0, '$EXPR'),
 (9, 'Kotlin', 0, 'println($$$ARGS)'), (9, 'Kotlin', 1, 'fun $NAME($$$ARGS) { $$$BODY }'), (10, 'Scala', 0, 'println($$$ARGS)'), (10, 'Scala', 1, 'def $NAME($$$ARGS) = $EXPR')) AS t(i, lang, no, pattern) ON c_custkey % 11 = i""")
def _p5(spark, sf_dir):
    """The presets of the language that each customer uses."""
    from .functions import languages

    presets = spark.createDataFrame([(lang, i, p) for lang in languages.LANGUAGES for i, (_, p) in enumerate(languages.presets(lang))], "lang string, no int, pattern string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _shape("c_custkey", [F.lit(n) for n in languages.LANGUAGES]).alias("lang"))
    return rows.join(F.broadcast(presets), "lang")


#: Extensions, the first language that claims each, and how many do.
_CLAIMED = [("rs", "Rust", 1), ("java", "Java", 1), ("py", "Python", 1), ("pyi", "Python", 1), ("js", "JavaScript", 1), ("jsx", "JavaScript", 1), ("mjs", "JavaScript", 1), ("cjs", "JavaScript", 1), ("ts", "TypeScript", 1), ("tsx", "TypeScript", 1), ("mts", "TypeScript", 1), ("cts", "TypeScript", 1), ("go", "Go", 1), ("cpp", "C++", 1), ("cc", "C++", 1), ("cxx", "C++", 1), ("h", "C++", 2), ("hpp", "C++", 1), ("hh", "C++", 1), ("hxx", "C++", 1), ("c", "C", 1), ("cs", "C#", 1), ("kt", "Kotlin", 1), ("kts", "Kotlin", 1), ("ktm", "Kotlin", 1), ("scala", "Scala", 1), ("sc", "Scala", 1), ("sbt", "Scala", 1), ("md", None, 0), ("txt", None, 0)]


def _named(spark, sf_dir) -> DataFrame:
    ext = _shape("c_custkey", [F.lit(e) for e, *_ in _CLAIMED])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("dir.d/"), F.col("c_custkey").cast("string"), F.lit("."), ext).alias("path"))


_CLAIMED_SQL = f"customer JOIN (VALUES {_values([(i, *c) for i, c in enumerate(_CLAIMED)])}) AS t(i, ext, lang, n) ON c_custkey % {len(_CLAIMED)} = i"


@query("w7_extension_map", f"SELECT c_custkey AS id, lang FROM {_CLAIMED_SQL}")
def _w7(spark, sf_dir):
    """Of all languages that claim a file's extension, the first."""
    from .functions import languages
    from .operators import windows

    files = _named(spark, sf_dir).withColumn("ext", languages.extension_of(F.col("path")))
    # the dimension has a row for each language and extension
    claims = files.join(F.broadcast(languages.dimension(spark)), "ext", "left")
    return windows.keep_first(claims, ["id"], ["priority"]).select("id", "lang")


@query("u1_extensions", f"SELECT c_custkey AS id, n AS claims FROM {_CLAIMED_SQL} WHERE n > 0")
def _u1(spark, sf_dir):
    """Files that the union of all languages' extensions lets through, and how many languages claim each."""
    from .functions import languages
    from .operators import filters

    files = _named(spark, sf_dir).where(filters.has_language_extension(F.col("path"), languages.AUTO))
    claims = F.aggregate(F.array(*[filters.has_language_extension(F.col("path"), lang).cast("int") for lang in languages.LANGUAGES]), F.lit(0), lambda a, x: a + x)
    return files.select("id", claims.alias("claims"))


@query("f6_runnable", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey % 5 <> 2 AND c_nationkey % 7 <> 4")
def _f6(spark, sf_dir):
    """Jobs that are enabled, with a pattern and a directory; each customer has one."""
    c = table(spark, sf_dir, "customer")
    jobs = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 != 0).alias("enabled"), F.when(F.col("c_nationkey") % 5 == 2, " \t").otherwise(F.col("c_name")).alias("pattern"), F.when(F.col("c_nationkey") % 7 == 4, "").otherwise("d").alias("search_dir"))
    return conditions.runnable_rows(jobs).select("id")


#: What a command line calls the languages.
_ALIASES = [("rust", "Rust"), ("rs", "Rust"), ("java", "Java"), ("python", "Python"), ("py", "Python"), ("javascript", "JavaScript"), ("js", "JavaScript"), ("typescript", "TypeScript"), ("ts", "TypeScript"), ("go", "Go"), ("c", "C"), ("cpp", "C++"), ("c++", "C++"), ("cc", "C++"), ("cxx", "C++"), ("csharp", "C#"), ("cs", "C#"), ("c#", "C#"), ("kotlin", "Kotlin"), ("kt", "Kotlin"), ("kts", "Kotlin"), ("ktm", "Kotlin"), ("scala", "Scala"), ("sc", "Scala"), ("sbt", "Scala"), ("perl", None)]


@query("f13_alias", f"SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN upper(alias) ELSE alias END AS typed, lang AS language FROM customer JOIN (VALUES {_values([(i, *a) for i, a in enumerate(_ALIASES)])}) AS t(i, alias, lang) ON c_custkey % {len(_ALIASES)} = i")
def _f13(spark, sf_dir):
    from .functions import languages

    typed = _shape("c_custkey", [F.lit(a) for a, _ in _ALIASES])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, F.upper(typed)).otherwise(typed).alias("typed"))
    return rows.withColumn("language", languages.language_of_alias(F.col("typed")))
