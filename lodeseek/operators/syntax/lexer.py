"""Tokens and token trees of eleven languages and of patterns in them."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

PAIRS = {"(": ")", "[": "]", "{": "}"}
_CLOSERS = set(PAIRS.values())

#: Operators, longest first.
_OPERATORS = ["<<=", ">>=", "===", "!==", "**=", "//=", "...", "..=", "??=", "&&=", "||=", ">>>", "<=>", "->*", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", "**", "//", "?.", "??", "?:", "!!", ":=", "<-", "..", "<:", ">:"]
_NUMBER = r"0[xXbBoO][0-9A-Fa-f_]+[A-Za-z0-9_]*|(?:\d[\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z_]*\d*"
_WORD = r"[^\W\d]\w*"
_C_COMMENTS = r"//[^\n]*|/\*.*?\*/"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_COMMENTS = {"Python": r"\#[^\n]*"}
_STRINGS = {
    "Python": rf"[rRbBuUfF]{{0,2}}(?:\"\"\".*?\"\"\"|'''.*?'''|{_DOUBLE}|{_SINGLE})",
    "Rust": rf"b?r(\#*)\".*?\"\1|b?{_DOUBLE}|b?'(?:\\.[^']*|[^'\\])'|'{_WORD}",
    "JavaScript": rf"{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*`",
    "Go": rf"{_DOUBLE}|{_SINGLE}|`[^`]*`",
    "C++": rf"(?:u8|[uUL])?R\"(\w*)\(.*?\)\1\"|(?:u8|[uUL])?{_DOUBLE}|[uUL]?{_SINGLE}",
    "C#": rf"[@$]{{0,2}}@\"(?:\"\"|[^\"])*\"|\$?{_DOUBLE}|{_SINGLE}",
    "Kotlin": rf"\"\"\".*?\"\"\"|{_DOUBLE}|{_SINGLE}",
    "Java": rf"\"\"\".*?\"\"\"|{_DOUBLE}|{_SINGLE}",
}
_STRINGS |= {"TypeScript": _STRINGS["JavaScript"], "C": _STRINGS["C++"], "Scala": rf"[a-z]?(?:\"\"\".*?\"\"\"|{_DOUBLE})|'(?:\\.|[^'\\])'"}
#: Languages in which a line end ends a statement.
BY_LINE = {"Python", "Go", "Kotlin", "Scala", "JavaScript", "TypeScript"}
META = re.compile(r"\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*")


class SyntaxProblem(ValueError):
    """The pattern is not one of the language, or not supported."""


@dataclass
class Leaf:
    text: str
    kind: str  # word, number, string, op, meta, many
    start: int
    end: int
    new_line: bool = False


@dataclass
class Group:
    open: str
    items: list
    start: int
    end: int
    new_line: bool = False
    kind: str = "group"
    text: str = field(default="", repr=False)


Item = Leaf | Group


@lru_cache(maxsize=64)
def _scanner(lang: str, pattern: bool) -> re.Pattern:
    comments = _COMMENTS.get(lang, _C_COMMENTS)
    directive = r"|(?m:^[ \t]*\#(?!include)[^\n]*(?:\\\n[^\n]*)*)" if lang in ("C", "C++") else ""
    meta = r"(?P<meta>\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*)|" if pattern else ""
    word = r"[^\W\d$]?[\w$]+" if lang in ("JavaScript", "TypeScript", "Java", "Scala") and not pattern else _WORD
    ops = "|".join(map(re.escape, _OPERATORS))
    strings = _STRINGS.get(lang, _STRINGS["Java"])
    return re.compile(rf"(?P<skip>{comments}{directive})|{meta}(?P<string>{strings})|(?P<number>{_NUMBER})|(?P<word>{word})|(?P<op>{ops}|[^\s\w])|(?P<blank>\s+)", re.DOTALL)


def tokens(source: str, lang: str, pattern: bool = False) -> list[Leaf]:
    out, fresh, at = [], True, 0
    for m in _scanner(lang, pattern).finditer(source):
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("skip", "meta", "string", "number", "word", "op", "blank") else next(k for k in ("skip", "meta", "string", "number", "word", "op", "blank") if k in m.re.groupindex and m[k] is not None)
        text = m[0]
        if kind in ("blank", "skip"):
            fresh = fresh or "\n" in text
            continue
        if kind == "meta" and text.startswith("$$$"):
            kind = "many"
        out.append(Leaf(text, kind, m.start(), m.end(), fresh))
        fresh = False
    return out


def tree(source: str, lang: str, pattern: bool = False) -> Group:
    """The token tree. In Python, indented lines below a line that ends in a colon are a group of their own."""
    root = Group("", [], 0, len(source))
    stack = [root]
    for t in tokens(source, lang, pattern):
        if t.kind == "op" and t.text in PAIRS:
            g = Group(t.text, [], t.start, len(source), t.new_line)
            stack[-1].items.append(g)
            stack.append(g)
        elif t.kind == "op" and t.text in _CLOSERS:
            # what does not close anything is dropped; what stays open inside is closed along
            at = next((i for i in range(len(stack) - 1, 0, -1) if PAIRS[stack[i].open] == t.text), 0)
            if at:
                for g in stack[at:]:
                    g.end = t.end
                del stack[at:]
            elif pattern:
                raise SyntaxProblem(f"unbalanced {t.text}")
        else:
            stack[-1].items.append(t)
    if pattern and len(stack) > 1:
        raise SyntaxProblem(f"unclosed {stack[-1].open}")
    if lang == "Python":
        starts = [0, *(m.end() for m in re.finditer("\n", source))]
        column = lambda p: p - starts[bisect_right(starts, p) - 1]
        root.items = _indented(root.items, column)
    return root


def _indented(items: list[Item], column) -> list[Item]:
    out: list[Item] = []
    i = 0
    line_column = column(items[0].start) if items else 0
    while i < len(items):
        x = items[i]
        if x.new_line:
            line_column = column(x.start)
        before = out[-1] if out else None
        if x.new_line and isinstance(before, Leaf) and before.text == ":" and i + 1 <= len(items):
            header = next((y for y in reversed(out) if y.new_line), out[0])
            if line_column > column(header.start):
                j = i + 1
                while j < len(items) and not (items[j].new_line and column(items[j].start) < line_column):
                    j += 1
                body = _indented(items[i:j], column)
                out.append(Group("indent", body, items[i].start, items[j - 1].end, True))
                i = j
                continue
        out.append(x)
        i += 1
    return out
