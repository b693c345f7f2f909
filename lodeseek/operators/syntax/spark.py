"""Syntax search and rewriting of files in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...cluster import checkpoint_folder
from ...functions.languages import AUTO
from ...functions.regexes import PatternError
from ...plans.conditions import SearchConditions
from .. import match
from . import matcher, receivers
from .lexer import META, SyntaxProblem

#: Languages that a fixed search may be in.
_ALL = ["Rust", "Java", "Python", "JavaScript", "TypeScript", "Go", "C++", "C", "C#", "Kotlin", "Scala"]


def check(pattern: str, lang: str) -> None:
    """PatternError where the pattern is in none of the languages that are searched."""
    problems = []
    for x in _ALL if lang == AUTO else [lang]:
        try:
            matcher.strategies(pattern, x)
            return
        except SyntaxProblem as e:
            problems.append(str(e))
    raise PatternError(problems[0])


def _literal(pattern: str) -> str:
    """The longest word that every hit must hold."""
    words = [w for part in META.split(pattern) for w in "".join(c if c.isalnum() or c == "_" else " " for c in part).split()]
    return max(words, key=len, default="")


def _rows(text: str, lang: str, pattern: str, wants_receiver: bool, path: str | None = None, headers: dict | None = None) -> list[dict]:
    try:
        found = matcher.find(text, pattern, lang)
    except SyntaxProblem:
        return []
    out = []
    for h in found:
        row = {}
        for at, line, col in ((h.start, "line_start", "col_start"), (h.end, "line_end", "col_end")):
            head = text[:at]
            row |= {line: head.count("\n") + 1, col: len(head.rsplit("\n", 1)[-1].encode())}
        hint = None
        if wants_receiver and "RECV" in h.names:
            a, b = h.names["RECV"]
            hint = receivers.receiver_type(text, lang, text[a:b], a, path, headers.get if headers else None)
        out.append(row | {"matched_text": text[h.start : h.end], "recv_type_hint": hint})
    return out


def _with_headers(files: DataFrame, all_files: DataFrame) -> DataFrame:
    """C++ files with the texts of what they take in, by path; others with null."""
    closure = include_closure(all_files.where(all_files["path"].rlike(r"\.(cpp|cc|cxx|h|hpp|hh|hxx)$")).select("path", "text"))
    texts = closure.join(all_files.select(F.col("path").alias("target"), F.col("text").alias("header")), "target")
    per = texts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("target", "header"))).alias("headers"))
    return files.join(per, "path", "left")


def search(files: DataFrame, conditions: SearchConditions, all_files: DataFrame | None = None) -> DataFrame:
    """Hits in files(path, source_language, text_encoding, text). Files without the pattern's longest word never reach Python.

    With all_files(path, text), receivers in C++ are also looked up in the headers that a file takes in."""
    check(conditions.pattern, conditions.selected_lang)
    pattern, wants = conditions.pattern, conditions.wants_receiver
    word = _literal(pattern)
    some = files.where(F.contains("text", F.lit(word))) if word else files

    headers = wants and all_files is not None and conditions.selected_lang in (AUTO, "C++")
    some = _with_headers(some, all_files) if headers else some.withColumn("headers", F.lit(None).cast("map<string,string>"))

    @F.pandas_udf(f"array<struct<{', '.join(match.HIT.replace(' ', ':').split(',:')).replace(' ', '')},recv_type_hint:string>>")
    def hits(text: pd.Series, lang: pd.Series, path: pd.Series, header: pd.Series) -> pd.Series:
        return pd.Series([_rows(t or "", g, pattern, wants, p, dict(h) if h is not None else None) for t, g, p, h in zip(text, lang, path, header, strict=True)])

    keep = ("path", "source_language", "text_encoding")
    # the generator's own filter would run the function a second time
    found = some.select(*keep, "text", hits("text", "source_language", "path", "headers").alias("hits"))
    lines = found.select(*keep, "hits", match.lines_of(F.col("text")).alias("lines"))
    names = [*match.HIT_COLUMNS, "recv_type_hint"]
    full = F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in names], *match.context(F.col("lines"), h, conditions.context_lines)))
    rows = lines.select(*keep, F.posexplode(full).alias("hit_no", "hit"))
    return rows.select(*keep, (F.col("hit_no") + 1).alias("hit_no"), *[f"hit.{c}" for c in match.HIT_COLUMNS], "hit.span_lines_text", "hit.context_before", "hit.context_after", "hit.recv_type_hint")


REWRITTEN = "struct<after:string,replacements:int,hit_pass_limit:boolean,error:string>"


def rewritten(files: DataFrame, pattern: str, template: str, lang: str = AUTO, hits: DataFrame | None = None) -> DataFrame:
    """files(path, source_language, text) that the rewrite changes, before and after, with their text_encoding if they have one; only those with hits, if hits are given.

    A rewrite that does not end within the pass limit has an error and no text after it, so none is written half rewritten."""
    check(pattern, lang)
    if hits is not None:
        files = files.join(hits.select("path").distinct(), "path", "left_semi")

    @F.pandas_udf(REWRITTEN)
    def apply(text: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(text, language, strict=True):
            try:
                done = matcher.rewrite(t or "", pattern, template, g)
                if done and done[2]:
                    rows.append((None, *done[1:], "the rewrite does not end within the pass limit"))
                else:
                    rows.append((*done, None) if done else (None, 0, False, None))
            except (SyntaxProblem, matcher.RewriteProblem) as e:
                rows.append((None, 0, False, str(e)))
        return pd.DataFrame(rows, columns=["after", "replacements", "hit_pass_limit", "error"])

    word = _literal(pattern)
    some = files.where(F.contains("text", F.lit(word))) if word else files
    keep = ["path", "source_language", *(["text_encoding"] if "text_encoding" in files.columns else [])]
    out = some.select(*keep, F.col("text").alias("before"), apply("text", "source_language").alias("r"))
    return out.select(*keep, "before", "r.*").where("replacements > 0 OR error IS NOT NULL")


def write_back(preview: DataFrame, target: str, encoding: str | None = None) -> DataFrame:
    """Write every changed file below the folder target, by its path; a row for each file with an error where it could not be written.

    Each file goes back in its own text_encoding, if the preview has that column, or else in UTF-8; encoding overrides both.
    A file is first written whole under a hidden name beside its place and then renamed, so a task that is lost leaves the
    old file or the new one, never a part, and may simply run again. Files are written where they belong only if the target
    is their root. A path that leads out of the target is an error. The folder must be one that all executors share."""
    from ...functions import encodings

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid
        from pathlib import Path

        for pdf in batches:
            errors = []
            for path, after, name in zip(pdf["path"], pdf["after"], pdf["text_encoding"], strict=True):
                staged = None
                try:
                    if ".." in path.split("/"):
                        raise OSError(f"{path} leads out of the folder")
                    raw = encodings.encode(after, name)
                    p = Path(target) / path.lstrip("/")
                    p.parent.mkdir(parents=True, exist_ok=True)
                    staged = p.with_name(f".{uuid.uuid4().hex}.part")
                    staged.write_bytes(raw)
                    if p.exists():
                        staged.chmod(p.stat().st_mode)
                    os.replace(staged, p)
                    errors.append(None)
                except (OSError, LookupError, encodings.DecodeError) as e:
                    errors.append(str(e))
                    if staged is not None:
                        staged.unlink(missing_ok=True)
            yield pd.DataFrame({"path": pdf["path"], "error": errors})

    own = F.col("text_encoding") if "text_encoding" in preview.columns else F.lit(None)
    name = F.coalesce(F.lit(encoding), own, F.lit("Utf8")).alias("text_encoding")
    return preview.where("path IS NOT NULL AND after IS NOT NULL").select("path", "after", name).mapInPandas(write, "path string, error string")


def include_rows(files: DataFrame) -> DataFrame:
    """path, target of every include of C and C++ files, as paths beside the including file."""

    @F.pandas_udf("array<string>")
    def targets(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[receivers._joined(p, i) for i in receivers.includes(t or "")] for p, t in zip(path, text, strict=True)])

    return files.select("path", F.explode(targets("path", "text")).alias("target"))


def include_closure(files: DataFrame, depth: int = receivers.INCLUDE_DEPTH) -> DataFrame:
    """path, target, depth: which files each file takes in, directly or not, up to a depth; each once, at its least depth."""
    checkpoint_folder(files.sparkSession)
    known = files.where(F.octet_length("text") <= receivers.INCLUDE_BYTES).select(F.col("path").alias("target"))
    edges = include_rows(files).join(known, "target", "left_semi").select("path", "target").distinct()
    step = edges.select(F.col("path").alias("via"), F.col("target").alias("next"))
    seen = edges.where("path <> target").withColumn("depth", F.lit(1))
    front = seen
    for d in range(2, depth + 1):
        more = front.join(step, F.col("target") == F.col("via")).select("path", F.col("next").alias("target")).distinct().where("path <> target")
        front = more.join(seen, ["path", "target"], "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def declaration_rows(files: DataFrame) -> DataFrame:
    """path, scope_start, scope_end, name, decl_type, decl_end of files(path, source_language, text)."""

    @F.pandas_udf("array<struct<scope_start:int,scope_end:int,name:string,decl_type:string,decl_end:int>>")
    def found(text: pd.Series, lang: pd.Series) -> pd.Series:
        names = ("scope_start", "scope_end", "name", "decl_type", "decl_end")
        return pd.Series([[dict(zip(names, d, strict=True)) for d in receivers.declarations(t or "", g)] for t, g in zip(text, lang, strict=True)])

    return files.select("path", F.explode(found("text", "source_language")).alias("d")).select("path", "d.*")
