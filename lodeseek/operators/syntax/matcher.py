"""Patterns over token trees.

A pattern is read as the language is. `$X` stands for one expression or token, `$$$X` for any number of neighbours,
`$_` for something unnamed; a name that comes twice must stand for the same text. Expressions are those that
precedence gives: in `a * b + c`, `$A + $B` has `a * b` on its left, and `b + c` is no expression at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from .lexer import BY_LINE, Group, Item, Leaf, SyntaxProblem, tree

#: Binary operators by how tightly they bind, loosest first.
_LEVELS = [
    ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "//=", "??=", "&&=", "||=", ":=", "<-"],
    ["=>"], ["?", "?:"], ["..", "..="], ["??"], ["||", "or"], ["&&", "and"], ["|"], ["^"], ["&"],
    ["==", "!=", "===", "!=="], ["<", ">", "<=", ">=", "<=>", "instanceof", "in", "is", "as", "!in", "!is"],
    ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%", "//"], ["**"],
]
_BINARY = {op: i for i, ops in enumerate(_LEVELS) for op in ops}
_RIGHT = set(_LEVELS[0]) | {"=>", "->", "**", "?", "??"}
_PREFIX = {"!", "-", "+", "~", "&", "*", "++", "--", "not", "new", "await", "typeof", "delete", "throw", "yield", "...", "mut", "void", "async"}
_MEMBER = {".", "->", "::", "?.", "!!.", "->*"}
_TIGHT = len(_LEVELS)
#: Words that begin statements or declarations, and are no operands.
KEYWORDS = set(
    """fn let const static struct enum impl trait mod use pub match if else for while loop return break continue class interface extends implements import package
    public private protected abstract final throws try catch finally switch case default do def lambda with raise from pass global nonlocal assert elif except
    function var export async func go defer chan select type range goto namespace template typename using typedef union operator virtual override override
    internal sealed record fun val when object companion data suspend given then extension foreach lock delegate event where unsafe dyn crate""".split()
)


def _op(x: Item | None) -> str | None:
    return x.text if isinstance(x, Leaf) and (x.kind == "op" or x.text in ("and", "or", "not", "in", "is", "as", "instanceof", "new", "await", "typeof", "delete", "throw", "yield", "mut", "void", "async")) else None


def _is_group(x: Item | None, opens: str) -> bool:
    return isinstance(x, Group) and x.open == opens


def _operand(x: Item | None) -> bool:
    return isinstance(x, Group) or (isinstance(x, Leaf) and (x.kind in ("number", "string", "meta", "many") or (x.kind == "word" and x.text not in KEYWORDS and _op(x) is None)))


class Expressions:
    """Where the expressions of a list of items begin and end."""

    def __init__(self, items: list[Item], lang: str, nested: bool):
        self.items, self.by_line = items, lang in BY_LINE and not nested
        self.strict_line = self.by_line and lang == "Python"
        self.members = _MEMBER if lang in ("C", "C++") else _MEMBER - {"->", "->*"}
        self.binary = _BINARY if lang in ("C", "C++") else _BINARY | {"->": _BINARY["=>"]}
        self.known: dict[tuple[int, int], tuple[int, ...]] = {}

    def get(self, i: int) -> Item | None:
        return self.items[i] if 0 <= i < len(self.items) else None

    def level_before(self, i: int) -> int:
        """How tightly an expression at i must bind, as to what stands before it; -1 where none can begin."""
        before = self.get(i - 1)
        if before is None:
            return 0
        op = _op(before)
        if op in self.members:
            return _TIGHT + 2
        if op in self.binary and (op not in _PREFIX or _operand(self.get(i - 2))):
            return self.binary[op] + (op not in _RIGHT)
        if op in _PREFIX:
            return _TIGHT + 1
        return 0

    def ends(self, i: int, level: int | None = None) -> tuple[int, ...]:
        """Ends of the expressions that begin at i, shortest first."""
        level = self.level_before(i) if level is None else level
        key = (i, level)
        if key not in self.known:
            self.known[key] = ()  # against endless descent
            self.known[key] = tuple(self._ends(i, level))
        return self.known[key]

    def _ends(self, i: int, level: int) -> list[int]:
        x = self.get(i)
        if x is None:
            return []
        out: list[int] = []
        behind = self.get(i - 1)
        if _operand(behind) and not (x.new_line and self.by_line) and (_op(x) in _PREFIX or _is_group(x, "(") or _is_group(x, "[")):
            return []  # a binary operator, or the arguments of a call
        if _is_group(x, "{") and _op(behind) in ("<", ">", ">>"):
            return []  # a body behind type arguments
        if _op(x) in _PREFIX:
            inner = self.ends(i + 1, _TIGHT + 1)
            if not inner:
                return []
            at = inner[-1]
        elif _operand(x):
            if _is_group(x, "{") and isinstance(self.get(i - 1), Leaf) and _operand(self.get(i - 1)):
                return []
            at = i + 1
            if level >= _TIGHT + 2:
                return [at]
            out.append(at)
            while (more := self._postfix(at)) > at:
                at = more
                out.append(at)
            if out[-1:] == [at]:
                out.pop()
        else:
            return []
        out.append(at)
        while (op := _op(self.get(at))) in self.binary and self.binary[op] >= level and not self._line_ends(at, op):
            right = self.ends(at + 1, self.binary[op] + (op not in _RIGHT))
            if not right:
                break
            at = right[-1]
            if op == "?" and _op(self.get(at)) == ":":
                other = self.ends(at + 1, self.binary[op])
                if not other:
                    break
                at = other[-1]
            out.append(at)
        return out

    def _line_ends(self, at: int, op: str | None = None) -> bool:
        x = self.get(at)
        return bool(self.by_line and x is not None and x.new_line and (self.strict_line or op is None or op in _PREFIX))

    def _postfix(self, at: int) -> int:
        x = self.get(at)
        if x is None:
            return at
        op = _op(x)
        if op in self.members and not (self.strict_line and x.new_line):
            y = self.get(at + 1)
            if isinstance(y, Leaf) and (y.kind in ("word", "meta", "number")):
                return at + 2
            return at
        if self._line_ends(at):
            return at
        if _is_group(x, "(") or _is_group(x, "["):
            return at + 1
        if op in ("++", "--") or (op in ("!!", "?") and not _operand(self.get(at + 1))):
            return at + 1
        if op == "!" and (_is_group(self.get(at + 1), "(") or _is_group(self.get(at + 1), "[")):
            return at + 2  # a macro call
        return at


@dataclass
class Hit:
    start: int
    end: int
    names: dict[str, tuple[int, int]]


def _separates(x: Item | None) -> bool:
    return x is None or _is_group(x, "{") or _is_group(x, "indent") or (isinstance(x, Leaf) and x.text in (";", "{", "}", ","))


class Matcher:
    """A compiled pattern."""

    def __init__(self, pattern: str, lang: str):
        if not pattern.strip():
            raise SyntaxProblem("empty pattern")
        self.lang, self.source = lang, pattern
        self.items = tree(pattern.strip(), lang, pattern=True).items
        if not self.items:
            raise SyntaxProblem("nothing to match in the pattern")
        if all(isinstance(x, Leaf) and x.kind == "many" for x in self.items):
            raise SyntaxProblem("a pattern needs more than $$$")
        own = Expressions(self.items, lang, False)
        #: Whether the whole pattern is one expression; else it is a statement or a declaration, or part of one.
        self.expression = len(self.items) in own.ends(0, 0)

    def find(self, source: str) -> list[Hit]:
        """All hits, in the order of place, outer ones before inner ones."""
        out: list[Hit] = []
        root = tree(source, self.lang)
        todo: list[tuple[Group, bool]] = [(root, False)]
        while todo:
            group, nested = todo.pop()
            here = Expressions(group.items, self.lang, nested)
            for i in range(len(group.items)):
                out += self._at(here, i, source)
            todo += [(x, x.open in "([") for x in group.items if isinstance(x, Group)]
        return sorted(out, key=lambda h: (h.start, -h.end))

    def _at(self, here: Expressions, i: int, source: str) -> list[Hit]:
        items = here.items
        if not self._first_fits(items[i]):
            return []
        if self.expression:
            wanted = set(here.ends(i))
            if not wanted:
                return []
        else:
            wanted = None
            if not self._may_begin(here, i):
                return []
        out, seen = [], set()
        for end, names in self._match(self.items, 0, here, i, {}, source, top=True):
            if end == i or end in seen or (wanted is not None and end not in wanted) or (wanted is None and not self._may_end(here, i, end)):
                continue
            seen.add(end)
            out.append(Hit(items[i].start, items[end - 1].end, names))
            if wanted is None:
                break
        return out

    def _first_fits(self, x: Item) -> bool:
        """Whether x may be the pattern's first item; asked before where expressions end, which takes far longer."""
        first = self.items[0]
        if isinstance(first, Group):
            return isinstance(x, Group) and x.open == first.open
        return first.kind in ("meta", "many") or (isinstance(x, Leaf) and x.text == first.text)

    def _may_begin(self, here: Expressions, i: int) -> bool:
        """Statements begin behind a separator, on a new line, or behind a word such as a modifier; keywords of a pattern begin anywhere."""
        first = self.items[0]
        before = here.get(i - 1)
        if _separates(before) or here.items[i].new_line:
            return True
        if isinstance(first, Leaf) and first.kind == "word" and first.text in KEYWORDS:
            return True
        return isinstance(before, Leaf) and (before.kind == "word" or before.text in (")", "]", ">")) or isinstance(before, Group)

    def _may_end(self, here: Expressions, i: int, end: int) -> bool:
        """A pattern that ends in $X has all of the expression there."""
        last = self.items[-1]
        if isinstance(last, Leaf) and last.kind == "meta" and end > i:
            return not (end < len(here.items) and here._postfix(end) > end and not _is_group(here.get(end), "("))
        return True

    def _match(self, pattern: list[Item], p: int, here: Expressions, i: int, names: dict, source: str, top: bool = False) -> Iterator[tuple[int, dict]]:
        """Ends of ways in which pattern[p:] fits from i on, and what names stand for."""
        items = here.items
        while p < len(pattern):
            want = pattern[p]
            if isinstance(want, Leaf) and want.kind == "many":
                last = p + 1 == len(pattern)
                stops = ([len(items)] if not top else [self._statement_end(here, i)]) if last else range(i, len(items) + 1)
                for j in stops:
                    held = self._bind(names, want.text[3:], items, i, j, source)
                    if held is not None:
                        yield from self._match(pattern, p + 1, here, j, held, source, top)
                return
            # a comma and $$$X behind it may both be missing at the end
            if isinstance(want, Leaf) and want.text == "," and p + 2 == len(pattern) and isinstance(pattern[p + 1], Leaf) and pattern[p + 1].kind == "many" and i == len(items):
                held = self._bind(names, pattern[p + 1].text[3:], items, i, i, source)
                if held is not None:
                    yield i, held
                return
            if i >= len(items):
                return
            x = items[i]
            if isinstance(want, Leaf) and want.kind == "meta":
                ends = here.ends(i) or ((i + 1,) if isinstance(x, Group) or x.kind == "word" else ())
                for j in reversed(ends):
                    held = self._bind(names, want.text[1:], items, i, j, source)
                    if held is not None:
                        yield from self._match(pattern, p + 1, here, j, held, source, top)
                return
            if isinstance(want, Group):
                if not isinstance(x, Group) or x.open != want.open:
                    return
                inner = Expressions(x.items, self.lang, x.open in "([")
                for end, held in self._match(want.items, 0, inner, 0, names, source):
                    if end == len(x.items) or (x.items[end:] and all(isinstance(y, Leaf) and y.text in (";", ",") for y in x.items[end:])):
                        yield from self._match(pattern, p + 1, here, i + 1, held, source, top)
                        break
                return
            if not isinstance(x, Leaf) or x.text != want.text:
                return
            p, i = p + 1, i + 1
        yield i, names

    def _statement_end(self, here: Expressions, i: int) -> int:
        j = i
        while j < len(here.items) and not (isinstance(here.items[j], Leaf) and here.items[j].text == ";") and not (j > i and here.by_line and here.items[j].new_line and here.items[j].kind != "group"):
            j += 1
        return j

    def _bind(self, names: dict, name: str, items: list[Item], i: int, j: int, source: str) -> dict | None:
        if not name or name == "_":
            return names
        span = (items[i].start, items[j - 1].end) if j > i else (0, 0)
        if name in names:
            a, b = names[name]
            return names if _same(source[a:b], source[span[0] : span[1]]) else None
        return names | {name: span}


def _same(a: str, b: str) -> bool:
    return a == b or re.sub(r"\s+", "", a) == re.sub(r"\s+", "", b)


def looks_like_qualified_call(pattern: str) -> bool:
    """A call such as `a::b($X)`, and not a statement."""
    t = pattern.strip()
    starts = ("if ", "for ", "while ", "switch ", "return ", "class ", "struct ")
    return "::" in t and "(" in t and t.endswith(")") and "{" not in t and "=" not in t and not t.endswith(";") and not t.startswith(starts)


@lru_cache(maxsize=256)
def strategies(pattern: str, lang: str) -> tuple[Matcher, ...]:
    """The pattern as it is; in C and C++ a qualified call also as the statement that it would be. SyntaxProblem if neither reads."""
    out = [Matcher(pattern, lang)]
    if lang in ("C", "C++") and looks_like_qualified_call(pattern):
        whole = Matcher(pattern.strip().rstrip(";"), lang)
        whole.expression = True
        out.append(whole)
    return tuple(out)


def find(source: str, pattern: str, lang: str) -> list[Hit]:
    """Hits of the first way to read the pattern that has any."""
    for m in strategies(pattern, lang):
        if hits := m.find(source):
            return hits
    return []


# ---------------------------------------------------------------- rewriting

#: As many as the reference's; a rewrite that never ends is not carried on beyond ENDLESS_PASSES.
MOST_PASSES, ENDLESS_PASSES = 10_000, 100
MOST_EDITS = 500_000


class RewriteProblem(ValueError):
    """Too many edits."""


def _filled(template: str, hit: Hit, source: str) -> str:
    from .lexer import META

    def value(m: re.Match) -> str:
        name = m[0].lstrip("$")
        if name not in hit.names:
            return "" if m[0].startswith("$$$") or name in ("_", "") else m[0]
        a, b = hit.names[name]
        return source[a:b]

    return META.sub(value, template)


@lru_cache(maxsize=256)
def endless(pattern: str, template: str, lang: str) -> bool:
    """Whether the template, with names for its values, holds hits that grow without end when they are rewritten."""
    from .lexer import META

    for m in strategies(pattern, lang):
        text = META.sub(lambda v: "zz" + v[0].strip("$").lower(), template)
        # values that move from place to place settle within a pass for each of them
        for _ in range(len(META.findall(pattern)) + 3):
            try:
                new = _pass(text, m.find(text), template)[0]
            except SyntaxProblem:  # the template is no text of its own
                break
            if len(new) <= len(text):
                break
            text = new
        else:
            return True
    return False


def _pass(text: str, hits: list[Hit], template: str) -> tuple[str, int]:
    """The text with its outermost hits replaced, and how many they are."""
    done, parts, count = 0, [], 0
    for h in hits:
        if h.start < done:
            continue
        parts += [text[done : h.start], _filled(template, h, text)]
        done = h.end
        count += 1
        if count > MOST_EDITS:
            raise RewriteProblem(f"more than {MOST_EDITS} edits")
    return "".join(parts) + text[done:], count


def rewrite(source: str, pattern: str, template: str, lang: str | None, most_passes: int | None = None) -> tuple[str, int, bool] | None:
    """The rewritten text, the number of edits, and whether the pass limit was hit; None where nothing changes.

    Every pass replaces the outermost hits; passes go on until the text stays as it is. A text at the pass limit is half rewritten."""
    if lang is None or lang == "Auto" or not pattern.strip():
        return None
    for m in strategies(pattern, lang):
        text, edits, capped = source, 0, True
        if not (hits := m.find(text)):
            continue
        for _ in range(most_passes or (ENDLESS_PASSES if endless(pattern, template, lang) else MOST_PASSES)):
            new, count = _pass(text, hits, template)
            if not count or new == text:
                capped = False
                break
            text, edits = new, edits + count
            hits = m.find(text)
        if text != source:
            return text, edits, capped
    return None
