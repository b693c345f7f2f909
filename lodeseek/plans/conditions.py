"""What is searched for: conditions, jobs, and their files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AST, TOKEN, PLAIN, REGEX = "Ast", "TokenSearch", "PlainText", "Regex"
MODES = (AST, TOKEN, PLAIN, REGEX)
#: Labels of modes and encodings in reports.
MODE_LABELS = {AST: "AST", TOKEN: "Token", PLAIN: "Text", REGEX: "Regex"}
DEFAULT_MAX_HITS = 100_000
DEFAULT_SKIP_DIRS = ".git;target;node_modules"
FILE_VERSION = 1


@dataclass(frozen=True)
class PlainTextOptions:
    case_insensitive: bool = False
    whole_word: bool = False


@dataclass(frozen=True)
class SearchConditions:
    search_dir: str = ""
    pattern: str = ""
    selected_lang: str = "Auto"
    context_lines: int = 2
    file_filter: str = ""
    file_encoding_preference: str = "Auto"
    max_file_size_mb: int = 10
    max_search_hits: int = DEFAULT_MAX_HITS
    skip_dirs: str = DEFAULT_SKIP_DIRS
    search_mode: str = AST
    plain_text_options: PlainTextOptions = field(default_factory=PlainTextOptions)

    @property
    def wants_receiver(self) -> bool:
        """Only a pattern that names it makes the receiver's type worth finding."""
        return "$RECV" in self.pattern

    def ready(self) -> bool:
        return self.pattern != "" and self.search_dir != ""

    def as_dict(self) -> dict:
        return asdict(self)


def conditions_from(d: dict) -> SearchConditions:
    """Conditions from a mapping in which any field may be missing."""
    known = {k: v for k, v in d.items() if k in SearchConditions.__dataclass_fields__}
    if isinstance(o := known.get("plain_text_options"), dict):
        known["plain_text_options"] = PlainTextOptions(**{k: v for k, v in o.items() if k in PlainTextOptions.__dataclass_fields__})
    return SearchConditions(**known)


@dataclass(frozen=True)
class PatternJob:
    id: int
    label: str
    enabled: bool = True
    conditions: SearchConditions = field(default_factory=SearchConditions)

    def runnable(self) -> bool:
        return self.enabled and bool(self.conditions.pattern.strip()) and bool(self.conditions.search_dir.strip())


def runnable_rows(jobs: DataFrame) -> DataFrame:
    """Of jobs(enabled, pattern, search_dir, ...) those that would run."""
    filled = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "")) > 0
    return jobs.where(F.col("enabled") & filled(F.col("pattern")) & filled(F.col("search_dir")))


def add_job(jobs: list[PatternJob], next_id: int, conditions: SearchConditions, label: str = "") -> tuple[list[PatternJob], int]:
    """The jobs with one more, made of the current conditions; and the next free id."""
    return [*jobs, PatternJob(next_id, label or conditions.pattern, True, conditions)], next_id + 1


def move_job(jobs: list[PatternJob], at: int, by: int) -> list[PatternJob]:
    """The jobs with one of them moved up (-1) or down (1); at the ends nothing changes."""
    out, to = list(jobs), at + by
    if 0 <= at < len(out) and 0 <= to < len(out):
        out[at], out[to] = out[to], out[at]
    return out


def renumbered(jobs: list[PatternJob]) -> tuple[list[PatternJob], int]:
    return [replace(j, id=i) for i, j in enumerate(jobs, 1)], len(jobs) + 1


class JobsFileError(ValueError):
    """The batch file cannot be read."""


def jobs_to_yaml(jobs: list[PatternJob]) -> str:
    import yaml

    rows = [{"id": j.id, "label": j.label, "enabled": j.enabled} | j.conditions.as_dict() for j in jobs]
    return yaml.safe_dump({"version": FILE_VERSION, "jobs": rows}, sort_keys=False, allow_unicode=True)


def jobs_from_yaml(text: str) -> tuple[list[PatternJob], int]:
    """Jobs, numbered from 1, and the next id. A file of a newer version is an error."""
    import yaml

    d = yaml.safe_load(text) or {}
    if not isinstance(d, dict):
        raise JobsFileError("not a batch file")
    if (version := d.get("version", FILE_VERSION)) > FILE_VERSION:
        raise JobsFileError(f"unsupported batch file version {version}")
    return renumbered([PatternJob(int(j.get("id", 0)), str(j.get("label", "")), bool(j.get("enabled", True)), conditions_from(j)) for j in d.get("jobs", [])])


def write_jobs(path: str, jobs: list[PatternJob]) -> None:
    Path(path).write_text(jobs_to_yaml(jobs), encoding="utf-8")


def read_jobs(path: str) -> tuple[list[PatternJob], int]:
    return jobs_from_yaml(Path(path).read_text(encoding="utf-8"))


@dataclass
class Settings:
    """What is kept between sessions."""

    conditions: SearchConditions = field(default_factory=SearchConditions)
    history: list[str] = field(default_factory=list)
    rewrite_template: str = ""
    jobs: list[PatternJob] = field(default_factory=list)
    next_job_id: int = 1

    MOST_HISTORY = 30

    def remember(self, pattern: str) -> None:
        """The latest pattern first, each once, the last 30."""
        self.history = [pattern, *[p for p in self.history if p != pattern]][: self.MOST_HISTORY]

    def suggestions(self, typed: str, most: int = 8) -> list[str]:
        return [p for p in self.history if typed in p and p != typed][:most]

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"conditions": self.conditions.as_dict(), "history": self.history, "rewrite_template": self.rewrite_template, "jobs": jobs_to_yaml(self.jobs), "next_job_id": self.next_job_id}, ensure_ascii=False, indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Settings:
        """Saved settings; defaults for a file or fields that are not there."""
        p = Path(path)
        d = json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
        jobs, next_id = jobs_from_yaml(d["jobs"]) if d.get("jobs") else ([], 1)
        return cls(conditions_from(d.get("conditions", {})), list(d.get("history", [])), d.get("rewrite_template", ""), jobs, max(next_id, d.get("next_job_id", 1)))
