"""Registered queries of the search engine over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import languages
from .operators import diff, filters, match, search, windows
from .plans.conditions import PLAIN, REGEX, TOKEN, PatternJob, PlainTextOptions, SearchConditions
from .sources.tables import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Extensions that the documents of the virtual tree are given, by doc_id.
TREE_EXTENSIONS = ["rs", "java", "py", "js", "ts", "go", "c", "h", "cs", "kt", "txt", "RS"]
_EXT_SQL = "['rs','java','py','js','ts','go','c','h','cs','kt','txt','RS'][CAST(doc_id % 12 AS INT) + 1]"
_LANG_SQL = """CASE lower(ext) WHEN 'rs' THEN 'Rust' WHEN 'java' THEN 'Java' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript'
 WHEN 'go' THEN 'Go' WHEN 'c' THEN 'C' WHEN 'h' THEN 'C++' WHEN 'cs' THEN 'C#' WHEN 'kt' THEN 'Kotlin' END"""
#: The documents as a tree of files: lang/source/doc_id.ext
_TREE_SQL = f"tree AS (SELECT *, lang || '/' || source || '/' || doc_id || '.' || ext AS path FROM (SELECT *, {_EXT_SQL} AS ext FROM documents))"
_LINES_SQL = """lined AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents)),
lines AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM lined)"""
_HIT_COLUMNS = ("line_start", "col_start", "line_end", "col_end", "matched_text")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, path, text, lang, source."""
    ext = F.element_at(F.array(*[F.lit(e) for e in TREE_EXTENSIONS]), (F.col("doc_id") % 12 + 1).cast("int"))
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs).select("doc_id", path.alias("path"), "text", "lang", "source")


def _plain(pattern: str, **options) -> SearchConditions:
    return SearchConditions(search_dir="documents", pattern=pattern, search_mode=PLAIN, plain_text_options=PlainTextOptions(**options))


def _places(spark: SparkSession, sf_dir: str, conditions: SearchConditions) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return match.only_places(docs, match.hits_column(docs, conditions), "doc_id")


def _line_hits_sql(needle: str, where: str = "TRUE", fold: bool = False) -> str:
    """Hits of a needle within lines: gaps between its places, summed up."""
    line = "lower(line)" if fold else "line"
    n = len(needle.encode())
    return f"""WITH {_LINES_SQL},
cut AS (SELECT doc_id, line_no, line, string_split({line}, '{needle}') AS g FROM lines WHERE contains({line}, '{needle}')),
hit AS (SELECT doc_id, line_no, line, g, unnest(generate_series(1, len(g) - 1)) AS k FROM cut),
placed AS (SELECT *, CAST(list_sum(list_transform(g[1:k], lambda x: strlen(x))) + (k - 1) * {n} AS INT) AS col_start,
           CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * {len(needle)} AS INT) AS pos FROM hit)
SELECT doc_id, CAST(line_no AS INT) AS line_start, col_start, CAST(line_no AS INT) AS line_end, CAST(col_start + {n} AS INT) AS col_end,
       substr(line, pos + 1, {len(needle)}) AS matched_text FROM placed WHERE {where}"""


_ALONE = "(pos = 0 OR regexp_full_match(substr(line, pos, 1), '\\s')) AND (pos + {n} >= length(line) OR regexp_full_match(substr(line, pos + {n} + 1, 1), '\\s'))"


def _text_hits_sql(re: str) -> str:
    """Hits of an expression in the whole text, which may cross lines."""
    return f"""WITH cut AS (SELECT doc_id, regexp_split_to_array(text, '{re}') AS g, regexp_extract_all(text, '{re}') AS m FROM documents),
hit AS (SELECT doc_id, g, m, unnest(generate_series(1, len(m))) AS k FROM cut WHERE len(m) > 0),
placed AS (SELECT doc_id, m[k] AS matched_text, array_to_string(list_transform(generate_series(1, k), lambda i: g[i] || CASE WHEN i < k THEN m[i] ELSE '' END), '') AS head FROM hit),
both_ AS (SELECT doc_id, matched_text, head, head || matched_text AS tail FROM placed)
SELECT doc_id, CAST(1 + strlen(head) - strlen(replace(head, chr(10), '')) AS INT) AS line_start, CAST(strlen(string_split(head, chr(10))[-1]) AS INT) AS col_start,
       CAST(1 + strlen(tail) - strlen(replace(tail, chr(10), '')) AS INT) AS line_end, CAST(strlen(string_split(tail, chr(10))[-1]) AS INT) AS col_end, matched_text FROM both_"""


def _marked_hits_sql(re: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The same by marks around the hits, so that empty ones show."""
    return f"""WITH cut AS (SELECT {key}, string_split(regexp_replace({text}, '{re}', chr(64976) || '\\0' || chr(64977), 'g'), chr(64976)) AS p FROM {source}),
each AS (SELECT {key}, [split_part(x, chr(64977), 1) for x in p[2:]] AS m, list_concat([p[1]], [split_part(x, chr(64977), 2) for x in p[2:]]) AS g FROM cut),
hit AS (SELECT {key}, g, m, unnest(generate_series(1, len(m))) AS k FROM each WHERE len(m) > 0),
placed AS (SELECT {key}, m[k] AS matched_text, array_to_string(list_transform(generate_series(1, k), lambda i: g[i] || CASE WHEN i < k THEN m[i] ELSE '' END), '') AS head FROM hit),
both_ AS (SELECT {key}, matched_text, head, head || matched_text AS tail FROM placed)
SELECT {key}, CAST(1 + strlen(head) - strlen(replace(head, chr(10), '')) AS INT) AS line_start, CAST(strlen(string_split(head, chr(10))[-1]) AS INT) AS col_start,
       CAST(1 + strlen(tail) - strlen(replace(tail, chr(10), '')) AS INT) AS line_end, CAST(strlen(string_split(tail, chr(10))[-1]) AS INT) AS col_end, matched_text FROM both_"""


# ---------------------------------------------------------------- match generators

query("m1_plain", _line_hits_sql("er"))(lambda s, d: _places(s, d, _plain("er")))
query("m2_whole_word", _line_hits_sql("the", _ALONE.format(n=3)))(lambda s, d: _places(s, d, _plain("the", whole_word=True)))
query("m3_ignore_case", _line_hits_sql("the", fold=True))(lambda s, d: _places(s, d, _plain("The", case_insensitive=True)))
query("m4_ignore_case_whole_word", _line_hits_sql("the", _ALONE.format(n=3), fold=True))(lambda s, d: _places(s, d, _plain("tHe", case_insensitive=True, whole_word=True)))
query("m5_regex", _text_hits_sql("[a-z]+tion[.,]"))(lambda s, d: _places(s, d, SearchConditions("documents", "[a-z]+tion[.,]", search_mode=REGEX)))
query("m5_regex_over_lines", _text_hits_sql("\\.\\s+[A-Z][a-z]+"))(lambda s, d: _places(s, d, SearchConditions("documents", r"\.\s+[A-Z][a-z]+", search_mode=REGEX)))
query("m5_repeated_alternatives", _text_hits_sql("(?:er|in|st|re)+[a-z]"))(lambda s, d: _places(s, d, SearchConditions("documents", "(?:er|in|st|re)+[a-z]", search_mode=REGEX)))
query("m5_empty_matches", _marked_hits_sql("(?m)^(?:t|h|e|a|s)*"))(lambda s, d: _places(s, d, SearchConditions("documents", "(?m)^(?:t|h|e|a|s)*", search_mode=REGEX)))


@query("m5_tag_texts", _marked_hits_sql("<(?:[^<>]|\\n)*>(?:[^<>]|\\n)+</", "pages", "page_id", "html"))
def _m5_tag_texts(spark, sf_dir):
    """Repeated alternatives that run over lines, in web pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = match.hits_column(pages, SearchConditions("pages", "<(?:[^<>]|\\n)*>(?:[^<>]|\\n)+</", search_mode=REGEX), "html")
    return match.only_places(pages, found, "page_id")


query("m6_token", _text_hits_sql("of\\s*the"))(lambda s, d: _places(s, d, SearchConditions("documents", "of the", search_mode=TOKEN)))


_PLACE_SQL = """WITH p AS (SELECT doc_id, strlen(text) AS n, string_split(text, chr(10)) AS g FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, k - 1 AS line, CAST(coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
 FROM (SELECT doc_id, n, unnest(generate_series(1, len(g))) AS k, unnest(list_transform(g, lambda x: strlen(x) + 1)) AS size FROM p))
SELECT doc_id, CAST(o AS INT) AS byte_offset, CAST(max(line) AS INT) AS line, CAST(least(o, max(n)) - max(begins) AS INT) AS col
FROM s, (VALUES (0), (7), (500), (100000)) AS t(o) WHERE begins <= least(o, n) GROUP BY doc_id, o"""


@query("m10_place_bytes", _PLACE_SQL)
@query("m10_place", _PLACE_SQL)
def _m10(spark, sf_dir):
    """Offsets in the bytes of all texts, whatever their characters."""
    return _placed(table(spark, sf_dir, "documents"))


def _placed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", F.explode(F.array(*[F.lit(x) for x in (0, 7, 500, 100000)])).alias("byte_offset"))
    line, col = match.place(F.col("text"), F.col("byte_offset"))
    return rows.select("doc_id", "byte_offset", line.alias("line"), col.alias("col"))


_CONTEXT_SQL = f"""WITH {_LINES_SQL},
hit AS (SELECT DISTINCT doc_id, line_no FROM (SELECT doc_id, line_no, line, unnest(generate_series(1, len(string_split(line, 'tion.')) - 1)) AS k FROM lines WHERE contains(line, 'tion.'))),
n AS (SELECT h.doc_id, h.line_no, (SELECT len(ls) FROM lined WHERE lined.doc_id = h.doc_id) AS c FROM hit h)
SELECT n.doc_id, CAST(n.line_no AS INT) AS line_start, l.ls[n.line_no] AS span_lines_text,
       array_to_string(l.ls[greatest(1, n.line_no - 2):n.line_no - 1], chr(10)) AS context_before,
       array_to_string(l.ls[n.line_no + 1:least(c, n.line_no + 2)], chr(10)) AS context_after,
       rtrim(array_to_string(l.ls[greatest(1, n.line_no - 2):least(c, n.line_no + 2)], chr(10)), chr(10)) AS program
FROM n JOIN lined l ON l.doc_id = n.doc_id"""


@query("m12_context", _CONTEXT_SQL)
def _m12(spark, sf_dir):
    """Context before and after, span text (m13) and the joined text with context (f10), once for each line with hits."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hits = match.exploded(docs, match.hits_column(docs, _plain("tion.")), 2, "doc_id")
    joined = [F.array_join(c, "\n").alias(c) for c in ("context_before", "context_after")]
    text = match.with_context_text(F.col("context_before"), F.col("span_lines_text"), F.col("context_after")).alias("program")
    return hits.select("doc_id", "line_start", "span_lines_text", *joined, text).distinct()


@query("m14_refresh", f"""WITH {_LINES_SQL}, {_TREE_SQL}
SELECT t.path, CAST(l.line_no AS INT) AS line_start, array_to_string(d.ls[greatest(1, l.line_no - 1):l.line_no - 1], chr(10)) AS before_, array_to_string(d.ls[l.line_no + 1:least(len(d.ls), l.line_no + 1)], chr(10)) AS after_
FROM lines l JOIN tree t USING (doc_id) JOIN lined d USING (doc_id) WHERE contains(line, 'worthless')""")
def _m14(spark, sf_dir):
    files = tree(spark, sf_dir)
    hits = search.search(files, _plain("worthless"))
    again = match.refreshed(hits, files, 1)
    return again.select("path", "line_start", F.array_join("context_before", "\n").alias("before_"), F.array_join("context_after", "\n").alias("after_")).distinct()


@query("m15_highlight", f"""WITH {_LINES_SQL}, h AS ({_text_hits_sql(chr(92) + '.' + chr(92) + 's+[A-Z][a-z]+')}),
c AS (SELECT doc_id, unnest(generate_series(line_start, line_end)) AS line_no, h.* EXCLUDE (doc_id) FROM h),
m AS (SELECT doc_id, line_no, CASE WHEN line_no = line_start THEN col_start ELSE 0 END AS from_col, CASE WHEN line_no = line_end THEN col_end END AS to_col,
      row_number() OVER (PARTITION BY doc_id, line_no ORDER BY line_start, col_start) AS k FROM c)
SELECT m.doc_id, CAST(m.line_no AS INT) AS line_no, CAST(from_col AS INT) AS from_col, CAST(coalesce(to_col, -1) AS INT) AS to_col FROM m JOIN lines l ON l.doc_id = m.doc_id AND l.line_no = m.line_no WHERE k = 1""")
def _m15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = _places(spark, sf_dir, SearchConditions("documents", r"\.\s+[A-Z][a-z]+", search_mode=REGEX))
    lines = docs.select("doc_id", F.posexplode(match.lines_of(F.col("text"))).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("line_no"))
    return diff.highlights(hits, lines, "doc_id").withColumn("to_col", F.coalesce("to_col", F.lit(-1)))


# ---------------------------------------------------------------- caps, order


@query("l1_cap", f"""WITH {_TREE_SQL}, h AS ({_line_hits_sql("er")})
SELECT path, line_start, col_start, matched_text FROM h JOIN tree USING (doc_id) ORDER BY path, line_start, col_start LIMIT 500""")
def _l1(spark, sf_dir):
    return search.capped_search(tree(spark, sf_dir), _plain("er"), 500).select("path", "line_start", "col_start", "matched_text")


@query("l1_cap_flag", f"WITH h AS ({_line_hits_sql('er')}) SELECT least(count(*), 500) AS total_matches, count(*) > 500 AS hit_limit_reached FROM h")
def _a14(spark, sf_dir):
    return search.statistics(search.places(tree(spark, sf_dir), _plain("er")), None, 500).select("total_matches", "hit_limit_reached")


@query("l5_ranges", """WITH r AS (SELECT doc_id % 50 AS g, n_chars % 97 AS s, n_chars % 97 + doc_id % 13 AS e, doc_id FROM documents),
d AS (SELECT g, e, greatest(s, coalesce(max(e) OVER (PARTITION BY g ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM (SELECT DISTINCT g, s, e FROM r))
SELECT g, s AS start, e AS "end" FROM d WHERE s < e""")
def _l5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    start = F.col("n_chars") % 97
    return windows.clipped(docs.select((F.col("doc_id") % 50).alias("g"), start.alias("start"), (start + F.col("doc_id") % 13).alias("end")).distinct(), "g")


@query("l6_topk", """SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8""")
def _l6(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(8)


@query("l8_viewport", f"""WITH {_TREE_SQL}, h AS ({_line_hits_sql("er")}), o AS (SELECT path, line_start, col_start, row_number() OVER (ORDER BY path, line_start, col_start) AS rn FROM h JOIN tree USING (doc_id))
SELECT path, line_start, col_start, rn FROM o WHERE rn BETWEEN 4001 AND 4040""")
def _l8(spark, sf_dir):
    """Forty rows of all hits, from the 4,001st on."""
    hits = search.places(tree(spark, sf_dir), _plain("er")).select("path", "line_start", "col_start", F.lit(1).alias("units"))
    seen = windows.Heights(hits, ["path", "line_start", "col_start"]).between(4000, 4040)
    return seen.select("path", "line_start", "col_start", F.col("bottom").alias("rn"))


# ---------------------------------------------------------------- filters and dimensions


@query("s2_skip_dirs", f"WITH {_TREE_SQL} SELECT path FROM tree WHERE source NOT IN ('src0', 'src1') AND lang <> 'de'")
def _s2(spark, sf_dir):
    return tree(spark, sf_dir).where(filters.not_in_dirs(F.col("path"), "src0; src1;de;")).select("path")


@query("s7_relative", f"WITH {_TREE_SQL} SELECT path, substr(path, length(lang) + 2) AS relative_path FROM tree")
def _s7(spark, sf_dir):
    from .sources.tables import relative

    return tree(spark, sf_dir).select("path", relative(F.col("path"), F.col("lang")).alias("relative_path"))


@query("f1_glob", f"WITH {_TREE_SQL} SELECT path FROM tree WHERE regexp_matches(string_split(path, '/')[-1], '^1.*\\.java$') OR regexp_matches(string_split(path, '/')[-1], '^.*\\.py$')")
def _f1(spark, sf_dir):
    return tree(spark, sf_dir).where(filters.name_matches(F.col("path"), "1*.java; *.py;[")).select("path")


@query("f2_extension", f"WITH {_TREE_SQL} SELECT path FROM tree WHERE ext NOT IN ('txt', 'RS')")
def _f2(spark, sf_dir):
    return tree(spark, sf_dir).where(filters.has_language_extension(F.col("path"), languages.AUTO)).select("path")


@query("f3_language", f"WITH {_TREE_SQL} SELECT path, {_LANG_SQL} AS language FROM tree")
def _f3(spark, sf_dir):
    return tree(spark, sf_dir).select("path", languages.language_of(languages.extension_of(F.col("path"))).alias("language"))


@query("f4_resolve", f"WITH {_TREE_SQL} SELECT path, coalesce({_LANG_SQL}, 'Rust') AS language FROM tree")
def _f4(spark, sf_dir):
    return tree(spark, sf_dir).select("path", languages.resolve(F.col("path"), languages.AUTO).alias("language"))


@query("f5_size", f"WITH {_TREE_SQL} SELECT path, strlen(text) AS length FROM tree WHERE strlen(text) <= 4096")
def _f5(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    # 256 times the size against a limit of one megabyte
    return tree(spark, sf_dir).where(filters.small_enough(size * 256, 1)).select("path", size.alias("length"))


@query("f11_history", "SELECT source, max(doc_id) AS used FROM documents WHERE contains(source, 'src1') AND source <> 'src1' GROUP BY source ORDER BY used DESC, source LIMIT 8")
def _f11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.contains("source", F.lit("src1")) & (F.col("source") != "src1"))
    return windows.recent(docs.select("source", F.col("doc_id").alias("used")), "source", "used", 8)


@query("f12_shortened", """WITH l AS (SELECT doc_id, substr(text, 1, doc_id % 60 + 1) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 40 THEN '...' || substr(t, length(t) - 36) ELSE t END AS path_label, CASE WHEN length(t) > 28 THEN substr(t, 1, 25) || '…' ELSE t END AS hint_label FROM l""")
def _f12(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", F.lit(1), (F.col("doc_id") % 60 + 1).cast("int")).alias("t"))
    return t.select("doc_id", windows.path_label(F.col("t")).alias("path_label"), windows.hint_label(F.col("t")).alias("hint_label"))


@query("d6_binary", """WITH t AS (SELECT doc_id, substr(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat(chr(1), 30) || text WHEN 2 THEN repeat('�', 9) || text ELSE '' END, 1, 4096) AS h FROM documents)
SELECT doc_id, length(h) > 0 AND ((length(h) - length(replace(h, '�', ''))) * 4 + length(h) - length(regexp_replace(h, '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'))) * 20 > length(h) AS is_binary FROM t""")
def _d6(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.repeat(F.lit("\x01"), 30), "text")).when(k == 2, F.concat(F.repeat(F.lit("�"), 9), "text")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", filters.looks_binary(text).alias("is_binary"))


# ---------------------------------------------------------------- joins


@query("j1_ext_dim", f"WITH {_TREE_SQL} SELECT path, CASE WHEN ext <> 'RS' THEN {_LANG_SQL} END AS language FROM tree")
def _j1(spark, sf_dir):
    dim = windows.keep_first(languages.dimension(spark), ["ext"], ["priority"])
    files = tree(spark, sf_dir).withColumn("ext", languages.extension_of(F.col("path")))
    # the dimension has a row for each known extension, in small letters
    return files.drop("lang").join(F.broadcast(dim), "ext", "left").select("path", F.col("lang").alias("language"))


@query("j3_anti", f"WITH {_TREE_SQL} SELECT path FROM tree WHERE source NOT IN ('src0', 'src7') AND lang <> 'de'")
def _j3(spark, sf_dir):
    """Files none of whose folders, on any level, is on a list of folders to skip."""
    skip = spark.createDataFrame([("src0",), ("src7",), ("de",)], "name string")
    return filters.without_components(tree(spark, sf_dir).select("path"), skip).select("path")


@query("j4_jobs_x_files", f"""WITH {_TREE_SQL}, a AS ({_line_hits_sql("er")}), b AS ({_line_hits_sql("the", _ALONE.format(n=3))}), c AS ({_text_hits_sql("[a-z]+tion[.,]")})
SELECT 1 AS job_id, path, count(*) AS hits FROM a JOIN tree USING (doc_id) WHERE source <> 'src0' GROUP BY path
UNION ALL SELECT 2, path, count(*) FROM b JOIN tree USING (doc_id) WHERE ext = 'py' GROUP BY path UNION ALL SELECT 3, path, count(*) FROM c JOIN tree USING (doc_id) GROUP BY path""")
def _j4(spark, sf_dir):
    """Three jobs with filters of their own, in one scan."""
    return search.search_many(tree(spark, sf_dir), _JOBS).groupBy("job_id", "path").agg(F.count(F.lit(1)).alias("hits"))


_JOBS = [
    PatternJob(1, "er", True, SearchConditions("documents", "er", search_mode=PLAIN, skip_dirs="src0")),
    PatternJob(2, "the", True, SearchConditions("documents", "the", search_mode=PLAIN, file_filter="*.py", plain_text_options=PlainTextOptions(whole_word=True))),
    PatternJob(3, "tion", True, SearchConditions("documents", "[a-z]+tion[.,]", search_mode=REGEX)),
]


@query("j5_hit_files", f"WITH {_TREE_SQL} SELECT path, length(text) AS n FROM tree WHERE contains(text, 'worthless')")
def _j5(spark, sf_dir):
    files = tree(spark, sf_dir)
    hits = search.places(files, _plain("worthless"))
    return files.join(hits.select("path").distinct(), "path", "left_semi").select("path", F.length("text").cast("long").alias("n"))


@query("j6_innermost", """WITH p AS (SELECT l_orderkey % 100 AS f, l_linenumber * 37 + l_orderkey % 211 AS pos FROM lineitem), s AS (SELECT DISTINCT f, lo, hi, 'scope' || lo AS scope FROM (SELECT f, x * 50 AS lo, x * 50 + 49 AS hi FROM (SELECT DISTINCT f FROM p), generate_series(0, 8) AS t(x)
 UNION ALL SELECT f, x * 50 + 10, x * 50 + 19 FROM (SELECT DISTINCT f FROM p), generate_series(0, 8) AS t(x)))
SELECT d.f, d.pos, arg_max(scope, lo) AS scope FROM (SELECT DISTINCT f, pos FROM p) d LEFT JOIN s ON s.f = d.f AND d.pos BETWEEN lo AND hi GROUP BY d.f, d.pos""")
def _j6(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("f"), (F.col("l_linenumber") * 37 + F.col("l_orderkey") % 211).alias("at")).distinct()
    x = p.select("f").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(8))))
    wide, narrow = x.select("f", (F.col("x") * 50).alias("lo"), (F.col("x") * 50 + 49).alias("hi")), x.select("f", (F.col("x") * 50 + 10).alias("lo"), (F.col("x") * 50 + 19).alias("hi"))
    scopes = wide.union(narrow).select("f", F.col("lo").alias("scope_start"), F.col("hi").alias("scope_end"), F.concat(F.lit("scope"), F.col("lo").cast("string")).alias("scope"))
    return diff.innermost(p, scopes, ["f"]).withColumnRenamed("at", "pos")


@query("j7_asof_declaration", """WITH u AS (SELECT event_id, user_id, epoch_us(ts) AS pos FROM events WHERE event_type <> 'signup'), d AS (SELECT user_id, epoch_us(ts) AS decl_end, max(event_id) AS t FROM events WHERE event_id % 7 = 0 GROUP BY ALL)
SELECT u.event_id, u.user_id, CAST((SELECT arg_max(t, decl_end) FROM d WHERE d.user_id = u.user_id AND d.decl_end < u.pos) AS VARCHAR) AS decl_type FROM u""")
def _j7(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit("events").alias("path"), F.col("user_id").cast("string").alias("name"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), "event_type")
    uses = e.where("event_type <> 'signup'").select("path", "name", F.col("ms").alias("start"), "event_id", "user_id")
    decl = e.where("event_id % 7 = 0").groupBy("path", "name", F.col("ms").alias("decl_end")).agg(F.max("event_id").cast("string").alias("decl_type"))
    return diff.as_of(uses, decl, ["path"]).select("event_id", "user_id", F.col("type").alias("decl_type"))


@query("j8_left_hint", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL ELSE 'q' || l.quality END AS hint FROM documents d LEFT JOIN labels l USING (doc_id)")
def _j8(spark, sf_dir):
    hints = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("hint"))
    return table(spark, sf_dir, "documents").select("doc_id").join(hints, "doc_id", "left")


# ---------------------------------------------------------------- aggregates


@query("a1_totals", f"WITH h AS ({_line_hits_sql('er')}) SELECT count(*) AS total_matches, count(DISTINCT doc_id) AS total_files, (SELECT count(*) FROM documents) AS scanned FROM h")
def _a1(spark, sf_dir):
    files = tree(spark, sf_dir)
    return search.statistics(search.places(files, _plain("er")), files).select("total_matches", "total_files", "scanned")


@query("a3_per_file", f"WITH {_TREE_SQL}, h AS ({_line_hits_sql('er')}) SELECT path, count(*) AS hits FROM h JOIN tree USING (doc_id) GROUP BY path")
def _a3(spark, sf_dir):
    return search.per_file(search.places(tree(spark, sf_dir), _plain("er")))


@query("a4_encodings", "SELECT array_to_string(list(lang || ' x' || n ORDER BY lang), ', ') AS summary FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def _a4(spark, sf_dir):
    return search.encoding_summary(table(spark, sf_dir, "documents").withColumn("text_encoding", F.col("lang")))


@query("a5_batch_totals", f"""WITH {_TREE_SQL}, a AS ({_line_hits_sql("er")}), b AS ({_line_hits_sql("the", _ALONE.format(n=3))}), c AS ({_text_hits_sql("[a-z]+tion[.,]")}),
r AS (SELECT count(*) AS m, count(DISTINCT path) AS f FROM a JOIN tree USING (doc_id) WHERE source <> 'src0' UNION ALL SELECT count(*), count(DISTINCT path) FROM b JOIN tree USING (doc_id) WHERE ext = 'py' UNION ALL SELECT count(*), count(DISTINCT path) FROM c JOIN tree USING (doc_id))
SELECT CAST(sum(m) AS BIGINT) AS matches, CAST(sum(f) AS BIGINT) AS files FROM r""")
def _a5(spark, sf_dir):
    per = search.search_many(tree(spark, sf_dir), _JOBS).groupBy("job_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("path").alias("f"))
    return per.agg(F.sum("m").alias("matches"), F.sum("f").alias("files"))


@query("a6_failed", f"WITH h AS ({_line_hits_sql('er')}) SELECT 3 AS runs, 2 AS failed, (SELECT count(*) FROM h) AS matches, (SELECT count(DISTINCT doc_id) FROM h) AS files")
def _a6(spark, sf_dir):
    """A batch of which one job fails by its pattern and one by its files; the third one's totals are the batch's."""
    def files_of(c):
        if c.search_dir == "none":
            raise FileNotFoundError(c.search_dir)
        return tree(spark, sf_dir)

    # totals of a job end at its cap, and this one counts every hit, so it has none
    jobs = [PatternJob(1, "a", True, SearchConditions("d", "(", search_mode=REGEX)), PatternJob(2, "b", True, SearchConditions("none", "er", search_mode=PLAIN)), PatternJob(3, "c", True, replace(_plain("er"), max_search_hits=0))]
    done = search.run_batch(files_of, jobs)
    return spark.createDataFrame([(len(done.runs), done.failed, done.total_matches, done.total_files)], "runs int, failed int, matches long, files long")


@query("a9_ranges", f"WITH h AS ({_line_hits_sql('tion')}) SELECT doc_id, count(*) AS match_count, array_to_string(list(line_start || ':' || col_start || '-' || col_end ORDER BY line_start, col_start), ' ') AS ranges FROM h GROUP BY doc_id")
def _a9(spark, sf_dir):
    hits = _places(spark, sf_dir, _plain("tion"))
    label = lambda s: F.concat(s["line_start"].cast("string"), F.lit(":"), s["col_start"].cast("string"), F.lit("-"), s["col_end"].cast("string"))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("match_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "col_start", "col_end"))), label), " ").alias("ranges"))


@query("a11_nested", f"WITH {_TREE_SQL}, h AS ({_line_hits_sql('worthless')}) SELECT path, count(*) AS n, array_to_string(list(line_start || ':' || col_start ORDER BY line_start, col_start), ' ') AS places FROM h JOIN tree USING (doc_id) GROUP BY path")
def _a11(spark, sf_dir):
    files = search.nested(search.search(tree(spark, sf_dir), _plain("worthless")))
    places = F.transform("matches", lambda h: F.concat(h["line_start"].cast("string"), F.lit(":"), h["col_start"].cast("string")))
    return files.select("path", F.size("matches").cast("long").alias("n"), F.array_join(places, " ").alias("places"))


@query("a13_units", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS units FROM documents")
def _a13(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", windows.display_lines(F.col("text")).cast("long").alias("units"))


# ---------------------------------------------------------------- windows and sets

_UNITS_SQL = "u AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS units FROM documents), p AS (SELECT *, CAST(sum(units) OVER (ORDER BY doc_id) AS BIGINT) AS bottom FROM u)"


def _heights(spark, sf_dir) -> windows.Heights:
    return windows.Heights(table(spark, sf_dir, "documents").select("doc_id", windows.display_lines(F.col("text")).cast("long").alias("units")), ["doc_id"])


@query("w1_prefix", f"WITH {_UNITS_SQL} SELECT doc_id, units, bottom, bottom - units AS top FROM p")
def _w1(spark, sf_dir):
    """Where every document begins and ends in one long list of them all."""
    return _heights(spark, sf_dir).rows.drop("page")


@query("w2_row_at", f"WITH {_UNITS_SQL} SELECT min(doc_id) AS doc_id FROM p WHERE bottom > 5000")
def _w2(spark, sf_dir):
    return _heights(spark, sf_dir).row_at(5000).select("doc_id")


@query("w4_dedupe", "SELECT text AS pattern, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _w4(spark, sf_dir):
    return windows.keep_first(table(spark, sf_dir, "documents").select(F.col("text").alias("pattern"), "doc_id"), ["pattern"], ["doc_id"])


@query("w5_recent", "SELECT user_id, max(epoch_us(ts)) AS used FROM events GROUP BY user_id ORDER BY used DESC, user_id LIMIT 30")
def _w5(spark, sf_dir):
    return windows.recent(table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("used")), "user_id", "used")


@query("w6_renumber", "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS id FROM nation")
def _w6(spark, sf_dir):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.row_number().over(w).cast("long").alias("id"))


@query("u3_union_runs", f"""WITH {_TREE_SQL}, a AS ({_line_hits_sql("er")}), b AS ({_line_hits_sql("tion")})
SELECT 1 AS job_id, path, line_start, col_start FROM a JOIN tree USING (doc_id) UNION ALL SELECT 2, path, line_start, col_start FROM b JOIN tree USING (doc_id)""")
def _u3(spark, sf_dir):
    files = tree(spark, sf_dir)
    runs = [search.places(files, _plain(p)).select(F.lit(i).alias("job_id"), "path", "line_start", "col_start") for i, p in ((1, "er"), (2, "tion"))]
    return runs[0].unionByName(runs[1])


# ---------------------------------------------------------------- diff


_DIFF_LINES = "CASE WHEN {0}[-1] = '' THEN {0}[1:len({0}) - 1] ELSE {0} END"


@query("x4_diff", f"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS x, regexp_split_to_array(replace(text, 'the', 'THE'), '\\r?\\n') AS y FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, {_DIFF_LINES.format('x')} AS a, {_DIFF_LINES.format('y')} AS b FROM s),
l AS (SELECT doc_id, unnest(generate_series(1, greatest(len(a), len(b)))) AS i, a, b FROM p),
r AS (SELECT doc_id, i, 0 AS k, CASE WHEN a[i] = b[i] THEN ' ' ELSE '-' END AS mark, a[i] AS line FROM l UNION ALL SELECT doc_id, i, 1, '+', b[i] FROM l WHERE a[i] <> b[i]
 UNION ALL SELECT doc_id, -1, 0, '---', 'before' FROM p UNION ALL SELECT doc_id, 0, 0, '+++', 'after' FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INT) AS no, mark, line FROM r""")
def _x4(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    return diff.positional(docs.select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit("the"), F.lit("THE")).alias("b")), "a", "b", "doc_id")


# ---------------------------------------------------------------- syntax

_SCRIPTS_SQL = "scripts AS (SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS text FROM pages)"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of every page as a file."""
    body = F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1)
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".js")).alias("path"), body.alias("text"))


def _syntax(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    hits = search.search(scripts(spark, sf_dir), SearchConditions("pages", pattern, "JavaScript"))
    return hits.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("page_id"), "line_start", "col_start", "col_end", "matched_text")


def _script_hits_sql(re: str) -> str:
    return f"""WITH {_SCRIPTS_SQL}, m AS (SELECT page_id, text, unnest(regexp_extract_all(text, '{re}')) AS matched_text FROM scripts)
SELECT page_id, 1 AS line_start, CAST(strlen(string_split(text, matched_text)[1]) AS INT) AS col_start, CAST(strlen(string_split(text, matched_text)[1]) + strlen(matched_text) AS INT) AS col_end, matched_text FROM m"""


query("m7_syntax_call", _script_hits_sql("track[(][0-9]+[)]"))(lambda s, d: _syntax(s, d, "track($N)"))
query("m7_syntax_declaration", _script_hits_sql('var t="</p>"'))(lambda s, d: _syntax(s, d, "var $NAME = $VALUE"))
query("m9_same_name", "SELECT n_nationkey, 'f(' || n_nationkey || ', ' || n_nationkey || ')' AS matched_text FROM nation")(
    lambda s, d: search.search(
        table(s, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.format_string("f(%d, %d)\nf(%d, x)\n", "n_nationkey", "n_nationkey", "n_nationkey").alias("text")),
        SearchConditions("nation", "f($X, $X)", "Python"),
    ).select(F.substring_index("path", ".", 1).cast("int").alias("n_nationkey"), "matched_text")
)


@query("x1_rewrite", f"WITH {_SCRIPTS_SQL} SELECT page_id, replace(text, 'track(', 'seen(') AS after_, 1 AS replacements FROM scripts WHERE contains(text, 'track(')")
def _x1(spark, sf_dir):
    """Rewrites of the files with hits (x2), with the edits of each (a7)."""
    from .operators.syntax import spark as syntax

    files = scripts(spark, sf_dir).withColumn("source_language", F.lit("JavaScript"))
    out = syntax.rewritten(files, "track($N)", "seen($N)", "JavaScript")
    return out.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("page_id"), F.col("after").alias("after_"), "replacements")


@query("r3_receiver_types", "SELECT n_nationkey, 'Type' || n_regionkey AS hint FROM nation")
def _r3(spark, sf_dir):
    source = F.format_string("class A { void f(Type%d it) { for (int i = 0; i < 3; i++) { it.go(i); } } }", "n_regionkey")
    files = table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".java")).alias("path"), source.alias("text"))
    hits = search.search(files, SearchConditions("nation", "$RECV.go($$$ARGS)", "Java"))
    return hits.select(F.substring_index("path", ".", 1).cast("int").alias("n_nationkey"), F.col("recv_type_hint").alias("hint"))


@query("r_declarations_join", "SELECT n_nationkey, 'Type' || n_regionkey AS hint FROM nation")
def _r_join(spark, sf_dir):
    """Declarations as rows, and the last one before a use by as-of join (j6 and j7 of receiver types)."""
    from .operators.syntax import spark as syntax

    source = F.format_string("class A { void f() { Other it = null; Type%d it = make(); it.go(); } }", "n_regionkey")
    files = table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".java")).alias("path"), F.lit("Java").alias("source_language"), source.alias("text"))
    decl = syntax.declaration_rows(files).select("path", "name", "decl_end", "decl_type")
    uses = files.select("path", F.lit("it").alias("name"), (F.instr("text", "it.go") - 1).alias("start"))
    return diff.as_of(uses, decl, ["path"]).select(F.substring_index("path", ".", 1).cast("int").alias("n_nationkey"), F.col("type").alias("hint"))


# ---------------------------------------------------------------- suggestions, explanations, dimensions

@query("p1_suggest")
def _p1(spark, sf_dir):
    """Patterns that fit each page's script; equal scripts are worked on once."""
    from .operators import suggest

    pages = scripts(spark, sf_dir).select("page_id", "text", F.sha2("text", 256).alias("digest"))
    found = suggest.suggestions(pages.groupBy("digest").agg(F.first("text").alias("text")), "digest", "text", "JavaScript")
    return pages.select("page_id", "digest").join(found, "digest").select("page_id", "position", "pattern", "description", "match_count")


@query("u2_union_dedupe", "SELECT pattern, arg_min(origin, pos) AS origin FROM (SELECT n_name AS pattern, 'nation' AS origin, n_nationkey AS pos FROM nation UNION ALL SELECT r_name, 'region', 100 + r_regionkey FROM region UNION ALL SELECT n_name, 'again', 200 + n_nationkey FROM nation) GROUP BY pattern")
def _u2(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lists = n.select(F.col("n_name").alias("pattern"), F.lit("nation").alias("origin"), F.col("n_nationkey").alias("pos"))
    lists = lists.unionByName(r.select(F.col("r_name").alias("pattern"), F.lit("region").alias("origin"), (F.col("r_regionkey") + 100).alias("pos")))
    lists = lists.unionByName(n.select(F.col("n_name").alias("pattern"), F.lit("again").alias("origin"), (F.col("n_nationkey") + 200).alias("pos")))
    return windows.keep_first(lists, ["pattern"], ["pos"]).select("pattern", "origin")


@query("j2_semi", f"WITH {_TREE_SQL} SELECT path FROM tree WHERE ext IN ('go', 'kt')")
def _j2(spark, sf_dir):
    # a few patterns of one filter
    globs = spark.createDataFrame([(p,) for p in filters.glob_patterns("*.go;*.kt")], "pattern string")
    return tree(spark, sf_dir).join(F.broadcast(globs), F.expr("regexp_like(substring_index(path, '/', -1), pattern)"), "left_semi").select("path")


# ---------------------------------------------------------------- sources, decoding, sinks


@query("s1_scan")
def _s1(spark, sf_dir):
    from .sources import tree as files

    return files.listing(spark, sf_dir)


@query("d1_decode", "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'Utf16Be' ELSE 'Utf8' END AS text_encoding, md5(text) AS digest FROM documents")
def _d1(spark, sf_dir):
    """Texts as UTF-8, UTF-8 with a mark (d2) and UTF-16 with a mark, decoded."""
    from .functions import encodings

    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    files = table(spark, sf_dir, "documents").select("doc_id", raw.alias("content"))
    return encodings.decoded(files).select("doc_id", "text_encoding", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("t1_hits_by_source", f"WITH h AS ({_line_hits_sql('er')}) SELECT lang, source, count(*) AS hits FROM h JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)")
def _t1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    hits = docs.select("lang", "source", F.size(match.hits_column(docs, _plain("er"))).alias("n"))
    return hits.rollup("lang", "source").agg(F.sum("n").alias("hits")).where("hits > 0")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capped_search(tree(spark, sf_dir), _plain("er"), 100_000).select("path", *_HIT_COLUMNS, F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


from . import shape_queries  # noqa: E402, F401  registers its queries here
