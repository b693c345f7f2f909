"""Best-effort types of call receivers, from the declarations around them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .lexer import Group, Item, Leaf, tree

#: Include walks end at this depth, and pass over larger files.
INCLUDE_DEPTH, INCLUDE_BYTES = 8, 512 * 1024

_TYPE = r"[A-Za-z_][\w.]*(?:\s*<[^;={}()]*>)?(?:\s*\[\s*\])*"
_CPP_SPECS = r"(?:(?:const|volatile|static|constexpr|inline|mutable|unsigned|signed|long|short|struct|class|typename)\s+)*[A-Za-z_]\w*(?:\s*::\s*[A-Za-z_]\w*)*(?:\s*<[^;={}()]*>)?(?:\s+(?:const|int|long|char|double))*"
_NO_TYPES = {"return", "new", "throw", "else", "case", "goto", "delete", "using", "namespace", "package", "import", "await", "yield", "if", "while", "for", "switch", "typedef", "public", "private", "protected", "final", "static"}


@dataclass
class Scope:
    """A brace group around a place, and the text before it."""

    group: Group
    header: str
    statements: list[tuple[int, int]]


def _statements(items: list[Item], source: str) -> list[tuple[int, int]]:
    """Spans of a block's statements: up to a semicolon, or a body in braces."""
    out, start = [], None
    for x in items:
        if start is None:
            start = x.start
        if isinstance(x, Leaf) and x.text == ";":
            out.append((start, x.start))
            start = None
        elif isinstance(x, Group) and x.open == "{":
            out.append((start, x.end))
            start = None
    if start is not None:
        out.append((start, items[-1].end))
    return out


def _headers(items: list[Item], at: int) -> int:
    """Where the text that leads to the group at items[at] begins."""
    start = items[at].start
    for x in reversed(items[:at]):
        if (isinstance(x, Leaf) and x.text in (";", "}")) or (isinstance(x, Group) and x.open == "{"):
            break
        start = x.start
    return start


def scopes_at(source: str, lang: str, place: int) -> list[Scope]:
    """Brace groups around a place, innermost first, and last the whole text."""
    root = tree(source, lang)
    chain, group = [Scope(root, "", _statements(root.items, source))], root
    while True:
        inside = next(((i, x) for i, x in enumerate(group.items) if isinstance(x, Group) and x.start <= place < x.end), None)
        if inside is None:
            return chain[::-1]
        i, inner = inside
        if inner.open == "{":
            chain.append(Scope(inner, source[_headers(group.items, i) : inner.start], _statements(inner.items, source)))
        group = inner


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and not (c == ">" and text[i - 1 : i] == "-"))
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def _parameters(header: str) -> list[str]:
    """Texts of the parameters in the last parenthesis of a header that is followed by no further one."""
    depth, end = 0, None
    for i in range(len(header) - 1, -1, -1):
        if header[i] == ")":
            depth += 1
            end = i if end is None else end
        elif header[i] == "(":
            depth -= 1
            if depth == 0:
                return [p.strip() for p in _split(header[i + 1 : end]) if p.strip()]
    return []


def _in_order(scope: Scope, source: str, before: int) -> Iterator[str]:
    """Statements of a block that end before a place, the last first."""
    for a, b in reversed(scope.statements):
        if b <= before:
            yield source[a:b]


def _class_of(scopes: list[Scope], words: str) -> str | None:
    for s in scopes:
        if m := re.search(rf"\b(?:{words})\s+(?:class\s+)?([A-Za-z_]\w*)", s.header):
            return m[1]
    return None


# ---------------------------------------------------------------- Java and C#


def _typed(statement: str, name: str) -> str | None:
    """The type of `Type name`, `Type name = ...` or one of several names."""
    text = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|(?:public|private|protected|internal|static|final|readonly|volatile|transient|event|const|ref|out|in|this|required)\s+)*", "", statement.strip())
    m = re.match(rf"({_TYPE})\s+([A-Za-z_]\w*)\s*(.*)$", text, re.DOTALL)
    if not m or m[1] in _NO_TYPES or m[3][:1] not in ("", "=", ",", ";", ":", "{", "["):
        return None
    for i, part in enumerate(_split(text[m.start(2) :])):
        d = re.match(r"\s*([A-Za-z_]\w*)\s*(?:=\s*(.*))?", part, re.DOTALL)
        if d and d[1] == name:
            return f"{m[1]}:({d[2].strip()})" if m[1] in ("var", "val") and d[2] else m[1].strip()
        if i == 0 and not d:
            return None
    return None


def _lambda_hides(source: str, scope: Scope, place: int, name: str) -> bool:
    before = source[scope.group.start : place] if scope.group.open else source[:place]
    tail = re.split(r"[;{}]", before)[-1]
    for m in re.finditer(r"(?:\(([\w\s,]*)\)|\b(\w+))\s*->", tail):
        if name in [x.strip() for x in (m[1] or m[2] or "").split(",")]:
            return True
    return False


def _java_like(source: str, lang: str, recv: str, place: int) -> str | None:
    scopes = scopes_at(source, lang, place)
    kinds = "class|interface|enum|record|struct"
    if recv in ("this", "super", "base"):
        return _class_of(scopes, kinds)
    if not re.fullmatch(r"[A-Za-z_]\w*", recv):
        return None
    for s in scopes:
        if lang == "Java" and _lambda_hides(source, s, place, recv):
            return None
        for statement in _in_order(s, source, place):
            if t := _typed(statement, recv):
                return t
        # a loop without braces around the place
        current = next((source[a:place] for a, b in s.statements if a <= place < b), "")
        for text in (current, s.header):
            if m := re.search(rf"\b(?:for|foreach)\s*\(\s*(?:final\s+)?({_TYPE})\s+{re.escape(recv)}\s*(?::|in\b)", text):
                return m[1].strip()
        if re.search(rf"\b(?:{kinds})\s+\w+", s.header):
            for a, b in s.statements:
                if t := _typed(source[a:b].split("=>")[0], recv):
                    return t
        if "(" in s.header:
            if re.search(rf"\(\s*(?:\w+\s*,\s*)*{re.escape(recv)}\s*(?:,\s*\w+\s*)*\)\s*->\s*$|\b{re.escape(recv)}\s*->\s*$", s.header):
                return None
            for p in _parameters(s.header):
                if t := _typed(re.sub(r"\.\.\.\s*", " ", p), recv):
                    return t
    return None


# ---------------------------------------------------------------- C++


def base_name(recv: str) -> str:
    """The variable that a chain of calls, members and subscripts starts from."""
    m = re.match(r"[\s(*&]*([A-Za-z_]\w*)", recv)
    return m[1] if m else recv.strip()


def _cpp_declares(statement: str, name: str) -> str | None:
    text = re.sub(r"^(?:(?:public|private|protected)\s*:\s*)+", "", statement.strip())
    m = re.match(rf"({_CPP_SPECS})(\s*[*&]+\s*|\s+)(?=[A-Za-z_*&])", text)
    if not m or m[1].split()[0] in _NO_TYPES:
        return None
    for part in _split(text[m.end(1) :]):
        d = re.match(r"\s*((?:[*&]\s*|const\s+)*)([A-Za-z_]\w*)\s*(?=$|[=({\[:])", part)
        if d and d[2] == name:
            ops = re.sub(r"\s+", "", d[1])
            return f"{re.sub(chr(92) + 's+', ' ', m[1]).strip()} {ops}".strip()
    return None


def _cpp_fields(scope: Scope, source: str, name: str) -> str | None:
    for a, b in scope.statements:
        text = source[a:b]
        if "(" in text.split("=")[0]:
            continue
        if t := _cpp_declares(text, name):
            return t
    return None


def _cpp_class(scopes: list[Scope]) -> str | None:
    for s in scopes:
        if m := re.search(r"\b([A-Za-z_]\w*)\s*::\s*~?[A-Za-z_]\w*\s*\(", s.header):
            return m[1]
        if m := re.search(r"\b(?:class|struct)\s+(?:\w+\s+)*?([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^:]|$)", s.header.strip()):
            return m[1]
    return None


def field_in_class(source: str, class_name: str, name: str) -> str | None:
    """The type of a field of a class that the text defines."""
    for m in re.finditer(rf"\b(?:class|struct)\s+(?:\w+\s+)*?{re.escape(class_name)}\b[^;{{]*{{", source):
        scope = scopes_at(source, "C++", m.end() - 1)[0]
        if t := _cpp_fields(scope, source, name):
            return t
    return None


def includes(source: str) -> list[str]:
    return [m[1] or m[2] for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)', source, re.MULTILINE)]


def _joined(path: str, name: str) -> str:
    parts = path.split("/")[:-1]
    for p in name.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def field_in_includes(source: str, path: str, class_name: str, name: str, read: Callable[[str], str | None], depth: int = 0, seen: set[str] | None = None) -> str | None:
    """The type of a field of a class that an included file defines, files at most INCLUDE_DEPTH deep, each read once."""
    seen = seen if seen is not None else {path}
    if depth >= INCLUDE_DEPTH:
        return None
    for inc in includes(source):
        target = _joined(path, inc)
        if target in seen:
            continue
        seen.add(target)
        text = read(target)
        if text is None or len(text.encode()) > INCLUDE_BYTES:
            continue
        if found := field_in_class(text, class_name, name) or field_in_includes(text, target, class_name, name, read, depth + 1, seen):
            return found
    return None


def _cpp(source: str, recv: str, place: int, path: str | None, read) -> str | None:
    scopes, name = scopes_at(source, "C++", place), base_name(recv)
    if name == "this" and recv.strip() == "this":
        return _cpp_class(scopes)
    for s in scopes:
        for statement in _in_order(s, source, place):
            if t := _cpp_declares(statement, name):
                return t
        for p in _parameters(re.sub(r"\)\s*:\s*[^{]*$", ")", s.header)):
            if t := _cpp_declares(p, name):
                return t
        if re.search(r"\b(?:class|struct)\s+\w+", s.header) and (t := _cpp_fields(s, source, name)):
            return t
    owner = _cpp_class(scopes)
    if owner is None:
        return None
    found = field_in_class(source, owner, name)
    if found is None and path is not None and read is not None:
        found = field_in_includes(source, path, owner, name, read)
    return found


# ---------------------------------------------------------------- the others


def _rust(source: str, recv: str, place: int) -> str | None:
    name = re.sub(r"^(?:&\s*)?(?:mut\s+)?", "", recv.strip()).strip()
    scopes = scopes_at(source, "Rust", place)
    if name in ("self", "Self"):
        for s in scopes:
            if m := re.search(r"\bimpl\b(.*)$", s.header, re.DOTALL):
                body = m[1].split(" for ")[-1] if " for " in m[1] else re.sub(r"^\s*<[^>]*>", "", m[1])
                return body.split(" where ")[0].strip() or None
        return None
    if scopes:
        for statement in _in_order(scopes[0], source, place):
            if m := re.match(rf"let\s+(?:mut\s+)?{re.escape(name)}\s*:\s*([^=;]+)", statement.strip()):
                return m[1].strip()
    return None


def _go(source: str, place: int) -> str | None:
    for s in scopes_at(source, "Go", place):
        if m := re.search(r"\bfunc\s*\(([^)]*)\)\s*\w+\s*\(", s.header):
            return m[1].split()[-1] if m[1].split() else None
    return None


def _typescript(source: str, lang: str, recv: str, place: int) -> str | None:
    scopes = scopes_at(source, lang, place)
    if recv == "this":
        return _class_of(scopes, "class")
    if m := re.match(r"\(?\s*.+?\s+as\s+([\w.<>\[\]]+)\s*\)?$", recv):
        return m[1]
    if not re.fullmatch(r"[A-Za-z_$][\w$]*", recv):
        return None
    for statement in _in_order(scopes[0], source, place) if scopes else ():
        if m := re.match(rf"(?:export\s+)?(let|const|var)\s+{re.escape(recv)}\s*(?::\s*([^=;]+?))?\s*(?:=\s*(.*))?$", statement.strip(), re.DOTALL):
            return m[2].strip() if m[2] else f"{m[1]}:({m[3].strip()})" if m[1] == "var" and m[3] else None
    for s in scopes:
        if re.search(r"\bclass\s+\w+", s.header):
            for a, b in s.statements:
                if m := re.search(rf"(?:^|\s){re.escape(recv)}\s*[?!]?\s*:\s*([^=;{{}}]+)", source[a:b]):
                    return m[1].strip()
    return None


def _python(source: str, recv: str, place: int) -> str | None:
    """The class around, by indentation; else an annotated attribute of it."""
    column = place - (source.rfind("\n", 0, place) + 1)
    for m in reversed(list(re.finditer(r"^([ \t]*)class\s+(\w+)[^\n]*:[ \t]*$", source[:place], re.MULTILINE))):
        if len(m[1]) < max(column, 1):
            if recv == "self":
                return m[2]
            body = source[m.end() :]
            end = re.search(rf"^(?![ \t]{{{len(m[1]) + 1},}}|\s*$)", body[1:], re.MULTILINE)
            a = re.search(rf"^[ \t]+{re.escape(recv.removeprefix('self.'))}\s*:\s*([^=\n#]+)", body[: end.start() + 1 if end else None], re.MULTILINE)
            return a[1].strip() if a else None
    return None


def receiver_type(source: str, lang: str, recv: str, place: int, path: str | None = None, read: Callable[[str], str | None] | None = None) -> str | None:
    """The type of the receiver text that stands at a place, or None."""
    recv = recv.strip()
    if lang in ("Java", "C#"):
        return _java_like(source, lang, recv, place)
    if lang == "C++":
        return _cpp(source, recv, place, path, read)
    if lang == "Rust":
        return _rust(source, recv, place)
    if lang == "Go":
        return _go(source, place)
    if lang in ("TypeScript", "JavaScript"):
        return _typescript(source, lang, recv, place)
    if lang == "Python":
        return _python(source, recv, place)
    if lang in ("Kotlin", "Scala") and recv in ("this", "super"):
        return _class_of(scopes_at(source, lang, place), "class|object|interface|trait")
    return None


def declarations(source: str, lang: str) -> list[tuple[int, int, str, str, int]]:
    """(scope_start, scope_end, name, type, end) of the typed declarations in a text, for as-of joins."""
    out = []
    todo = [tree(source, lang)]
    while todo:
        g = todo.pop()
        if g.open in ("", "{"):
            for a, b in _statements(g.items, source):
                names = re.findall(r"[A-Za-z_]\w*(?=\s*(?:[=,;:({\[]|$))", source[a:b])
                for n in dict.fromkeys(names):
                    t = _cpp_declares(source[a:b], n) if lang in ("C++", "C") else _typed(source[a:b], n) if lang in ("Java", "C#") else None
                    if t:
                        out.append((g.start, g.end, n, t, b))
        todo += [x for x in g.items if isinstance(x, Group)]
    return sorted(out)
