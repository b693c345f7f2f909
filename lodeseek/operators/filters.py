"""Which files are searched: predicates on their paths, sizes and texts, all built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def skipped_dirs(spec: str) -> list[str]:
    return [d for d in (x.strip() for x in spec.split(";")) if d]


def not_in_dirs(relative_path: Column, spec: str) -> Column:
    """No directory above the file, below the root, has one of the names."""
    names = skipped_dirs(spec)
    if not names:
        return F.lit(True)
    parts = F.split(relative_path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def without_components(files: DataFrame, skip: DataFrame) -> DataFrame:
    """files(path, ...) none of whose folders is in skip(name), a table of any size: an anti-join by exploded components."""
    parts = F.split("path", "/")
    dirs = files.select("path", F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("name"))
    hit = dirs.join(skip.select("name").distinct(), "name", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def glob_patterns(spec: str) -> list[str]:
    """Anchored expressions of a file filter; other metacharacters than the dot and the star keep their meaning. Invalid ones are dropped."""
    out = []
    for part in (x.strip() for x in spec.split(";")):
        if part:
            pattern = "^" + part.replace(".", r"\.").replace("*", ".*") + "$"
            if _compiles(pattern):
                out.append(pattern)
    return out


def _compiles(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it: Java's where there is a session."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, Py4JError, PySparkException):
        return False
    return True


def name_matches(path: Column, spec: str) -> Column | None:
    """The file filter on names; None where it has no pattern, and the default filter holds."""
    patterns = glob_patterns(spec)
    if not patterns:
        return None
    return reduce(lambda a, b: a | b, [file_name(path).rlike(p) for p in patterns])


def has_language_extension(path: Column, selected: str) -> Column:
    """The default filter of syntax search; it minds case."""
    return F.coalesce(languages.extension_of(path).isin([e for e, _ in languages.extension_mapping(selected)]), F.lit(False))


def small_enough(length: Column, max_mb: int) -> Column:
    """Files of unknown size stay."""
    return F.coalesce(length <= F.lit(max_mb * 1024 * 1024), F.lit(True))


def looks_binary(text: Column) -> Column:
    """More than one suspicious character in twenty among the first 4096; a replacement character counts for four."""
    head = F.substring(text, 1, 4096)
    total = F.length(head)
    broken = total - F.length(F.replace(head, F.lit("\ufffd"), F.lit("")))
    control = total - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F-\\x9F]", ""))
    return (total > 0) & ((broken * 4 + control) * 20 > total)


def narrowed(files: DataFrame, conditions) -> DataFrame:
    """files(path, text, length?) that the conditions let through, cheapest tests first."""
    path = F.col("path")
    out = files.where(not_in_dirs(path, conditions.skip_dirs))
    named = name_matches(path, conditions.file_filter)
    if named is not None:
        out = out.where(named)
    elif conditions.search_mode == "Ast":
        out = out.where(has_language_extension(path, conditions.selected_lang))
    size = F.col("length") if "length" in files.columns else F.octet_length("text")
    out = out.where(small_enough(size, conditions.max_file_size_mb)).where(~looks_binary(F.col("text")))
    if conditions.search_mode == "Ast" and conditions.selected_lang == languages.AUTO:
        out = out.where(languages.language_of(languages.extension_of(path)).isNotNull())
    return out
