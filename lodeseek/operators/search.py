"""A search over files, its cap, its statistics, and batches of searches."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages, regexes
from ..plans.conditions import AST, PatternJob, SearchConditions
from . import filters, match

ORDER = ("path", "line_start", "col_start", "hit_no")
COLUMNS = ("path", "source_language", "text_encoding", "hit_no", *match.HIT_COLUMNS, "span_lines_text", "context_before", "context_after", "recv_type_hint")


def search(files: DataFrame, conditions: SearchConditions) -> DataFrame:
    """Hits in files(path, text), lazily, uncapped and in no order. PatternError for a bad pattern."""
    narrow = filters.narrowed(files, conditions)
    lang = languages.resolve(F.col("path"), conditions.selected_lang)
    encoding = F.col("text_encoding") if "text_encoding" in files.columns else F.lit("UTF-8")
    narrow = narrow.select("path", lang.alias("source_language"), encoding.alias("text_encoding"), "text")
    keep = ("path", "source_language", "text_encoding")
    if conditions.search_mode == AST:
        from .syntax import spark as syntax

        return syntax.search(narrow, conditions, files)
    hits = match.exploded(narrow, match.hits_column(narrow, conditions), conditions.context_lines, *keep)
    return hits.withColumn("recv_type_hint", F.lit(None).cast("string"))


def places(files: DataFrame, conditions: SearchConditions) -> DataFrame:
    """The same hits without the lines around them: enough for counts and caps."""
    if conditions.search_mode == AST:
        return search(files, conditions).drop("span_lines_text", "context_before", "context_after")
    narrow = filters.narrowed(files, conditions)
    lang = languages.resolve(F.col("path"), conditions.selected_lang)
    encoding = F.col("text_encoding") if "text_encoding" in files.columns else F.lit("UTF-8")
    narrow = narrow.select("path", lang.alias("source_language"), encoding.alias("text_encoding"), match.hits_column(narrow, conditions).alias("hits"))
    # an inner explode would have the optimizer put a filter on the size of the hits below it, and find them twice
    rows = narrow.select("path", "source_language", "text_encoding", F.posexplode_outer("hits").alias("hit_no", "hit")).where("hit IS NOT NULL")
    return rows.select("path", "source_language", "text_encoding", (F.col("hit_no") + 1).alias("hit_no"), "hit.*", F.lit(None).cast("string").alias("recv_type_hint"))


#: Up to so many capped hits are sent to the files to fetch their context.
SENT_HITS = 200_000


def capped_search(files: DataFrame, conditions: SearchConditions, most: int | None = None) -> DataFrame:
    """The first hits by path and place, with context, in order. Only hits within the cap get context."""
    most = conditions.max_search_hits if most is None else most
    if conditions.search_mode == AST or not 0 < most <= SENT_HITS:
        return ordered(capped(search(files, conditions), most))
    first = capped(places(files, conditions), most)
    return ordered(match.with_context(first, files, conditions.context_lines).select(*COLUMNS))


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy(*ORDER)


def capped(hits: DataFrame, most: int) -> DataFrame:
    """The first hits by path and place; 0 is no cap. A top-k, so that no full sort is needed."""
    return ordered(hits).limit(most) if most else hits


def statistics(hits: DataFrame, scanned: DataFrame | None = None, most: int = 0) -> DataFrame:
    """One row: total_matches, total_files, scanned, hit_limit_reached."""
    total = hits.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("f"))
    seen = scanned.agg(F.count(F.lit(1)).alias("scanned")) if scanned is not None else hits.sparkSession.range(1).select(F.lit(None).cast("long").alias("scanned"))
    reached = (F.col("n") > most) if most else F.lit(False)
    # one row on each side
    both = total.join(F.broadcast(seen))
    return both.select((F.least("n", F.lit(most)) if most else F.col("n")).alias("total_matches"), F.col("f").alias("total_files"), "scanned", reached.alias("hit_limit_reached"))


def per_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("hits"))


def encoding_summary(files: DataFrame) -> DataFrame:
    """One row: `label xN, ...`, by label."""
    counts = files.groupBy("text_encoding").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_encoding", "n"))), lambda s: F.concat(s["text_encoding"], F.lit(" x"), s["n"].cast("string"))), ", ").alias("summary"))


def nested(hits: DataFrame) -> DataFrame:
    """A row for each file, with its hits in order; files as large as a report may hold."""
    cols = [*match.HIT_COLUMNS, "span_lines_text", "context_before", "context_after", "recv_type_hint"]
    each = F.struct("hit_no", *cols)
    grouped = hits.groupBy("path", "source_language", "text_encoding").agg(F.array_sort(F.collect_list(each)).alias("m"))
    return grouped.select("path", "source_language", "text_encoding", F.transform("m", lambda h: F.struct(*[h[c].alias(c) for c in cols])).alias("matches"))


@dataclass
class Run:
    """What became of a job."""

    job: PatternJob
    hits: DataFrame | None = None
    stats: dict = field(default_factory=dict)
    error: str | None = None


@dataclass
class Report:
    runs: list[Run]
    elapsed_ms: int = 0

    @property
    def total_matches(self) -> int:
        return sum(r.stats.get("total_matches", 0) for r in self.runs)

    @property
    def total_files(self) -> int:
        return sum(r.stats.get("total_files", 0) for r in self.runs)

    @property
    def failed(self) -> int:
        return sum(r.error is not None for r in self.runs)

    def hits(self) -> DataFrame | None:
        """All runs' hits, marked by job."""
        out = None
        for r in self.runs:
            if r.hits is not None:
                one = r.hits.withColumn("job_id", F.lit(r.job.id))
                out = one if out is None else out.unionByName(one)
        return out


class NothingToRun(ValueError):
    """No job is enabled and complete."""


def run_one(files: DataFrame, conditions: SearchConditions) -> tuple[DataFrame, dict]:
    """Capped hits and their statistics."""
    began = time.time()
    scanned = filters.narrowed(files, conditions)
    stats = statistics(places(files, conditions), scanned, conditions.max_search_hits).first().asDict()
    return capped_search(files, conditions), stats | {"elapsed_ms": int((time.time() - began) * 1000)}


def run_batch(files_of, jobs: list[PatternJob]) -> Report:
    """Runs the runnable jobs in order; a failing one is recorded and the rest go on. files_of(conditions) gives a job's files."""
    began, runs = time.time(), []
    todo = [j for j in jobs if j.runnable()]
    if not todo:
        raise NothingToRun("no job is enabled, with a pattern and a directory")
    for job in todo:
        run = Run(job)
        try:
            run.hits, run.stats = run_one(files_of(job.conditions), job.conditions)
        except Exception as e:  # whatever a job fails by, the others go on
            run.error = str(e)
        runs.append(run)
    return Report(runs, int((time.time() - began) * 1000))


def search_many(files: DataFrame, jobs: list[PatternJob]) -> DataFrame:
    """Hits of several text jobs in one pass over the files: each text meets all of them, and no join is made."""
    rows = []
    for j in jobs:
        c = j.conditions
        ok = filters.not_in_dirs(F.col("path"), c.skip_dirs) & filters.small_enough(F.octet_length("text"), c.max_file_size_mb)
        named = filters.name_matches(F.col("path"), c.file_filter)
        found = match.hits_column(files, c)
        rows.append(F.struct(F.lit(j.id).alias("job_id"), F.when(ok if named is None else ok & named, found).alias("hits")))
    each = files.where(~filters.looks_binary(F.col("text"))).select("path", F.explode(F.array(*rows)).alias("job"))
    return each.select("path", "job.job_id", F.explode("job.hits").alias("hit")).select("job_id", "path", "hit.*")


def sql_functions(spark: SparkSession) -> None:
    from ..sql import register

    register(spark)
