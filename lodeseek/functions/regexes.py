"""The search dialect of regular expressions, in terms of Java's.

Searches take linear-time expressions: Unicode classes, (?P<name>...), no look-around and no back-references. What
Java would take beyond that is an error here, and what it reads differently is rewritten.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class PatternError(ValueError):
    """The pattern is not valid."""


_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w", "ascii": r"\p{ASCII}"}
_ESCAPES = set("aftnrvxuUdDsSwWbBAzpP")
#: Turns of a repeated group that are no risk.
_FEW_TURNS = 32
_CATEGORY = re.compile(r"^(L|M|N|P|S|Z|C)[a-z&]?$")


def escape(text: str) -> str:
    """A pattern for just this text, in either engine."""
    return re.escape(text)


def _property(body: str) -> str:
    negated = body.startswith("^")
    name = body.lstrip("^").split("=")[-1]
    name = name if _CATEGORY.match(name) else "Is" + name
    return ("^" if negated else "") + name


def translate(pattern: str) -> str:
    """The Java pattern; PatternError where the dialect has no such thing."""
    out, i, n, in_class = ["(?dU)"], 0, len(pattern), 0
    multiline = bool(re.search(r"\(\?[a-z]*m[a-z]*(-[a-z]*)?[:)]", pattern))
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("incomplete escape at the end")
            e = pattern[i + 1]
            if e.isdigit() or e == "k":
                raise PatternError("back-references are not supported")
            if e.isascii() and e.isalpha() and e not in _ESCAPES:
                raise PatternError(f"unrecognised escape \\{e}")
            if e == "v":
                out.append(r"\x0B")
                i += 2
            elif e in "uUx" and (m := re.match(r"\\[uUx](?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{2}))", pattern[i:])):
                out.append(f"\\x{{{(m[1] or m[2]).lstrip('0') or '0'}}}")
                i += len(m[0])
            elif e in "pP" and (m := re.match(r"\\[pP](?:\{([^}]*)\}|([A-Za-z]))", pattern[i:])):
                body = _property(m[1] if m[1] is not None else m[2])
                flip = body.startswith("^")
                out.append(f"\\{('P' if e == 'p' else 'p') if flip else e}{{{body.lstrip('^')}}}")
                i += len(m[0])
            else:
                out.append(pattern[i : i + 2])
                i += 2
            continue
        if in_class:
            if c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                if m[2] not in _POSIX:
                    raise PatternError(f"unknown class {m[0]}")
                out.append(f"[{m[1]}{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]])
                i += len(m[0])
                continue
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            # a bracket that comes first is a literal
            m = re.match(r"\[\^?\]?", pattern[i:])
            out.append(m[0].replace("]", r"\]"))
            i += len(m[0])
            continue
        elif c == "(" and pattern.startswith("(?", i):
            if re.match(r"\(\?(=|!|<=|<!)", pattern[i:]):
                raise PatternError("look-around is not supported")
            if re.match(r"\(\?>|\(\?\(", pattern[i:]):
                raise PatternError("unsupported group")
            if (m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])) is not None:
                out.append(f"(?<{m[1].replace('_', 'U')}>")
                i += len(m[0])
                continue
            if (m := re.match(r"\(\?([A-Za-z-]*)[:)]", pattern[i:])) is not None and set(m[1]) - set("imsxu-"):
                raise PatternError(f"unsupported flags {m[1]}")
        elif c == "$" and not multiline:
            out.append(r"\z")
            i += 1
            continue
        elif c in "*+?}" and i + 1 < n and pattern[i + 1] == "+":
            raise PatternError("possessive quantifiers are not supported")
        out.append(c)
        i += 1
    return "".join(out)


def compiled(spark: SparkSession, pattern: str) -> str:
    """translate(), checked by Java's own compiler on the driver."""
    java = translate(pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:  # the gateway's error holds the compiler's message
        text = str(getattr(e, "java_exception", e)).split("\n")[0]
        raise PatternError(text) from None
    return java


def recurses(pattern: str) -> bool:
    """Whether Java's engine may go one call deeper, or try anew, for each turn of a repeated group: some text of tens of kilobytes then ends its JVM, or is never done."""
    bare = re.sub(r"\\.", "a", pattern, flags=re.S)
    bare = re.sub(r"\[\^?\]?(?:\[[^\]]*\]|[^\]])*\]", "c", bare)
    if re.search(r"\)[*+]", bare):
        return True
    return any(not high or int(high) > _FEW_TURNS for high in re.findall(r"\)\{\d*,?(\d*)\}", bare))


def may_be_empty(spark: SparkSession, java: str) -> bool:
    """Whether a match without characters turns up on a few probes."""
    p = spark._jvm.java.util.regex.Pattern.compile(java)
    for probe in ("", "a b", "\n", "a1_ .\n b"):
        m = p.matcher(probe)
        while m.find():
            if m.start() == m.end():
                return True
    return False


def literal_prefix(pattern: str) -> str:
    """A text that every match of the pattern must start with; empty if none is sure."""
    out = []
    i = 0
    if "|" in pattern or pattern.startswith("(?"):
        return ""
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            c, step = pattern[i + 1], 2
        elif c in "\\.[](){}*+?^$|":
            break
        else:
            step = 1
        if i + step < len(pattern) and pattern[i + step] in "*?{":
            break
        out.append(c)
        i += step
    return "".join(out)


def stays_in_line(pattern: str) -> bool:
    """Whether it is plain that no match can hold a line end; unsure is False."""
    if re.search(r"\[\^|\[:|&&|\(\?[a-zA-Z-]*[sx]|[\r\n]", pattern):
        return False
    bare = re.sub(r"\\[dwbBAz.+*?()\[\]{}|^$/\\-]", "", pattern)
    return "\\" not in bare and not re.search(r"\[[^\]]*[\x00-\x1f!-/]-", bare)
