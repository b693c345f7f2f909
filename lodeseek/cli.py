"""A command line for syntax searches: `run -p PATTERN [-l LANG] [-C N] [-A N] [-B N] [DIR]`."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import languages
from .plans.conditions import AST, SearchConditions

#: What a run takes where nothing is said.
MAX_FILE_MB, MAX_HITS, SKIP_DIRS = 10, 0, ".git;target;node_modules"


class CommandError(ValueError):
    """The command cannot be read."""


@dataclass(frozen=True)
class RunArgs:
    pattern: str
    lang: str = languages.AUTO
    context_before: int = 0
    context_after: int = 0
    search_dir: str = ""

    def conditions(self, default_dir: str = ".") -> SearchConditions:
        return SearchConditions(self.search_dir or default_dir, self.pattern, self.lang, max(self.context_before, self.context_after), "", "Auto", MAX_FILE_MB, MAX_HITS, SKIP_DIRS, AST)


def tokenize(line: str) -> list[str]:
    """Words of a command, with quotes and backslashes; quotes around nothing give no word."""
    out, word, quote, i = [], "", None, 0
    while i < len(line):
        c = line[i]
        if quote == "'":
            quote, word = (None, word) if c == "'" else (quote, word + c)
        elif c == "\\" and i + 1 < len(line) and (quote is None or line[i + 1] in '"\\'):
            i += 1
            word += line[i]
        elif quote == '"':
            quote, word = (None, word) if c == '"' else (quote, word + c)
        elif c in "\"'":
            quote = c
        elif c.isspace():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
        i += 1
    if quote:
        raise CommandError("unclosed quote")
    return [*out, word] if word else out


def is_search_command(line: str, program: str = "sg") -> bool:
    t = line.strip()
    return t == program or t.startswith((f"{program} ", "-p ", "--pattern "))


def parse_run(line: str, program: str = "sg") -> RunArgs:
    words = tokenize(line)
    for head in (program, "run"):
        if words[:1] == [head]:
            words = words[1:]
    got: dict = {}
    options = {"-p": "pattern", "--pattern": "pattern", "-l": "lang", "--lang": "lang", "-C": "both", "--context": "both", "-A": "context_after", "--after": "context_after", "-B": "context_before", "--before": "context_before"}
    while words:
        w = words.pop(0)
        if w in options:
            if not words:
                raise CommandError(f"{w} needs a value")
            name, value = options[w], words.pop(0)
            if name == "lang":
                lang = languages.from_alias(value)
                if lang is None:
                    raise CommandError(f"unknown language {value}")
                got["lang"] = lang
            elif name == "pattern":
                got["pattern"] = value
            elif not value.isdigit():
                raise CommandError(f"{w} needs a number")
            else:
                got |= {k: int(value) for k in (("context_before", "context_after") if name == "both" else (name,))}
        elif w.startswith("-"):
            raise CommandError(f"unknown option {w}")
        else:
            got["search_dir"] = w
    if "pattern" not in got:
        raise CommandError("no pattern: give -p or --pattern")
    return RunArgs(**got)


PARSED = "pattern string, lang string, context_before int, context_after int, search_dir string, error string"


def parsed(line: Column) -> Column:
    """Commands as structs of their arguments, or their error."""
    names = [c.split()[0] for c in PARSED.split(", ")]

    @F.pandas_udf(PARSED)
    def read(lines: pd.Series) -> pd.DataFrame:
        rows = []
        for x in lines:
            try:
                r = parse_run(x or "")
                rows.append((*[getattr(r, n) for n in names[:-1]], None))
            except CommandError as e:
                rows.append((None,) * 5 + (str(e),))
        return pd.DataFrame(rows, columns=names).astype({"context_before": "Int32", "context_after": "Int32"})

    return read(line)


def change_dir(current: str, line: str) -> str | None:
    """The folder after a `cd` command; None for other commands. `..` stays as it is written."""
    words = line.strip().split(None, 1)
    if not words or words[0] != "cd":
        return None
    to = words[1].strip().strip("\"'") if len(words) > 1 else ""
    return current if not to else to if to.startswith("/") else f"{current.rstrip('/')}/{to}"


def rendered(files: list[dict], stats: dict) -> list[str]:
    """Results as lines: path, numbered lines with a mark on those of the hit, a blank line between hits, and a summary."""
    out = []
    for f in files:
        out.append(f["path"])
        for h in f["matches"]:
            first = h["line_start"] - len(h["context_before"])
            shown = [*[(" ", x) for x in h["context_before"]], *[(">", x) for x in (h["span_lines_text"] or h["matched_text"]).split("\n")], *[(" ", x) for x in h["context_after"]]]
            out += [f"{mark} {first + i:>5} | {text}" for i, (mark, text) in enumerate(shown)]
            out.append("")
    out.append(f"{stats.get('total_matches', 0)} matches in {stats.get('total_files', 0)} files ({stats.get('elapsed_ms', 0)} ms)")
    return out


def main(argv: list[str] | None = None) -> int:
    import shlex
    import sys

    from pyspark.sql import SparkSession

    from .cluster import ship
    from .operators import search
    from .sinks import report
    from .sources import tree

    try:
        args = parse_run(shlex.join(sys.argv[1:] if argv is None else argv))
    except CommandError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    c = args.conditions()
    hits, stats = search.run_one(tree.files(spark, c), c)
    for r in search.ordered(report.blocks(hits, "terminal", c)).toLocalIterator():
        print(r["block"], end="")
    print(rendered([], stats)[-1])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
