"""Languages: extensions, command-line names, presets, and their lookups as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUTO = "Auto"

#: Languages in the order in which an extension is looked up; the first that claims it wins.
EXTENSIONS = {
    "Rust": ["rs"],
    "Java": ["java"],
    "Python": ["py", "pyi"],
    "JavaScript": ["js", "jsx", "mjs", "cjs"],
    "TypeScript": ["ts", "tsx", "mts", "cts"],
    "Go": ["go"],
    "C++": ["cpp", "cc", "cxx", "h", "hpp", "hh", "hxx"],
    "C": ["c", "h"],
    "C#": ["cs"],
    "Kotlin": ["kt", "kts", "ktm"],
    "Scala": ["scala", "sc", "sbt"],
}
#: Names that a command line takes.
ALIASES = {
    "Rust": ["rust", "rs"],
    "Java": ["java"],
    "Python": ["python", "py"],
    "JavaScript": ["javascript", "js"],
    "TypeScript": ["typescript", "ts"],
    "Go": ["go"],
    "C": ["c"],
    "C++": ["cpp", "c++", "cc", "cxx"],
    "C#": ["csharp", "cs", "c#"],
    "Kotlin": ["kotlin", "kt", "kts", "ktm"],
    "Scala": ["scala", "sc", "sbt"],
}
#: Preset patterns and their labels.
PRESETS = {
    "Rust": [("Function definition", "fn $NAME($$$ARGS)"), ("Trait impl", "impl $TRAIT for $TYPE"), ("unwrap call", "$VAR.unwrap()"), ("clone call", "$VAR.clone()"), ("panic!", "panic!($$$ARGS)")],
    "Java": [("Null check", "$VAR == null"), ("println", "System.out.println($$$ARGS)")],
    "Python": [("print call", "print($$$ARGS)"), ("import", "import $MODULE")],
    "JavaScript": [("console.log", "console.log($$$ARGS)")],
    "TypeScript": [("console.log", "console.log($$$ARGS)")],
    "Go": [("Error check", "if err != nil { $$$BODY }")],
    "Kotlin": [("println", "println($$$ARGS)"), ("Function", "fun $NAME($$$ARGS) { $$$BODY }")],
    "Scala": [("println", "println($$$ARGS)"), ("Definition", "def $NAME($$$ARGS) = $EXPR")],
}
_ANY = [("Any expression", "$EXPR")]
LANGUAGES = list(EXTENSIONS)
#: What a file of unknown extension is labelled outside of syntax search.
FALLBACK = "Rust"

_BY_EXTENSION: dict[str, str] = {}
for _lang, _exts in EXTENSIONS.items():
    for _ext in _exts:
        _BY_EXTENSION.setdefault(_ext, _lang)
_BY_ALIAS = {a: lang for lang, names in ALIASES.items() for a in names}


def from_extension(ext: str | None) -> str | None:
    return _BY_EXTENSION.get((ext or "").lstrip(".").lower())


def from_path(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return from_extension(name.rsplit(".", 1)[1]) if "." in name[1:] else None


def from_alias(name: str) -> str | None:
    """The language of a command-line name; None for auto and unknown ones."""
    return _BY_ALIAS.get(name.lower())


def label(lang: str) -> str:
    return "Auto (extension)" if lang == AUTO else lang


def presets(lang: str) -> list[tuple[str, str]]:
    return PRESETS.get(lang, _ANY)


def extension_mapping(lang: str) -> list[tuple[str, str]]:
    """Extension and language that a search in lang covers: sorted for Auto, in the language's own order else."""
    return sorted(_BY_EXTENSION.items()) if lang == AUTO else [(e, lang) for e in EXTENSIONS[lang]]


def union_extensions() -> set[str]:
    return set(_BY_EXTENSION)


def dimension(spark: SparkSession) -> DataFrame:
    """ext, lang, priority: a row for each claim of an extension."""
    rows = [(e, lang, i) for i, (lang, exts) in enumerate(EXTENSIONS.items()) for e in exts]
    return spark.createDataFrame(rows, "ext string, lang string, priority int")


def extension_of(path: Column) -> Column:
    """The extension of a path's file name, without the dot; null where there is none."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language_of(ext: Column) -> Column:
    return _lookup(_BY_EXTENSION, F.lower(F.regexp_replace(ext, r"^\.+", "")))


def language_of_alias(name: Column) -> Column:
    return _lookup(_BY_ALIAS, F.lower(name))


def resolve(path: Column, selected: str) -> Column:
    """The language that a file is searched in: the selected one, else its extension's, else the fallback."""
    return F.lit(selected) if selected != AUTO else F.coalesce(language_of(extension_of(path)), F.lit(FALLBACK))
