"""POSIX extended regular expressions and shell globs, translated on the driver to Java's syntax.

A pattern that cannot be compiled matches nothing, so translators return None for it.
"""

from __future__ import annotations

import re

#: POSIX character classes in Java's spelling.
CLASSES = {
    "alpha": "\\p{Alpha}",
    "digit": "\\p{Digit}",
    "alnum": "\\p{Alnum}",
    "upper": "\\p{Upper}",
    "lower": "\\p{Lower}",
    "space": "\\s\\x0B",
    "blank": "\\p{Blank}",
    "punct": "\\p{Punct}",
    "cntrl": "\\p{Cntrl}",
    "graph": "\\p{Graph}",
    "print": "\\p{Print}",
    "xdigit": "\\p{XDigit}",
}
_SPECIAL = set("\\.[]{}()*+-?^$|&~#")


class _Bad(Exception):
    pass


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _bracket(p: str, i: int, negators: str, escapes: bool) -> tuple[str, int]:
    """The bracket expression that starts at p[i] == '['; where it ends."""
    i += 1
    negate = i < len(p) and p[i] in negators
    i += negate
    items, first = [], True
    while True:
        if i >= len(p):
            raise _Bad("unclosed bracket")
        c = p[i]
        if c == "]" and not first:
            break
        first = False
        if c == "[" and p[i + 1 : i + 2] == ":":
            end = p.find(":]", i + 2)
            if end < 0 or p[i + 2 : end] not in CLASSES:
                raise _Bad("unknown class")
            items.append(CLASSES[p[i + 2 : end]])
            i = end + 2
            continue
        if c == "[" and p[i + 1 : i + 2] in (".", "="):
            raise _Bad("collating elements are not supported")
        if c == "\\" and escapes and i + 1 < len(p):
            i += 1
            c = p[i]
        if p[i + 1 : i + 2] == "-" and i + 2 < len(p) and p[i + 2] != "]":
            high = p[i + 2]
            step = 3
            if high == "\\" and escapes and i + 3 < len(p):
                high, step = p[i + 3], 4
            if high < c:
                raise _Bad("range out of order")
            items.append(f"{_literal(c)}-{_literal(high)}")
            i += step
            continue
        items.append(_literal(c))
        i += 1
    return f"[{'^' if negate else ''}{''.join(items)}]", i + 1


def _java_compiles(pattern: str) -> bool:
    """Python's compiler stands in for Java's on the driver, once class names are spelled out."""
    plain = pattern
    for name in CLASSES.values():
        plain = plain.replace(name, "a")
    try:
        re.compile(plain.replace("\\z", "\\Z"))
    except re.error:
        return False
    return True


def ere_to_java(p: str, fold: bool = False) -> str | None:
    """An unanchored search pattern; the dot matches newlines and $ only the very end."""
    out, i, open_ = [], 0, 0
    try:
        while i < len(p):
            c = p[i]
            if c == "[":
                piece, i = _bracket(p, i, "^", escapes=False)
                out.append(piece)
                continue
            if c == "\\":
                if i + 1 == len(p):
                    raise _Bad("trailing backslash")
                n = p[i + 1]
                if n in "wWsSbB":
                    out.append("\\" + n)
                elif n in "123456789":
                    out.append("\\" + n)
                elif n in "<>":
                    out.append("\\b(?=\\w)" if n == "<" else "\\b(?<=\\w)")
                else:
                    out.append(_literal(n))
                i += 2
                continue
            if c == "{" and not re.match(r"\{\d+(,\d*)?\}", p[i:]):
                raise _Bad("bad interval") if i and re.match(r"\{\d", p[i:]) else _Bad("bad brace")
            if c in "*+?{" and (not out or out[-1] in ("(", "|")) and c != "*":
                raise _Bad("nothing to repeat")
            if c == "*" and (not out or out[-1] in ("(", "|", "^")):
                out.append("\\*")
                i += 1
                continue
            if c == "{":
                end = p.index("}", i)
                out.append(p[i : end + 1])
                i = end + 1
                continue
            if c in "*+?" and out and out[-1] in ("*", "+", "?"):
                # A repeated repetition: POSIX nests it, Java would read it as lazy or possessive.
                if c == out[-1]:
                    i += 1
                    continue
                out[-1] = "*"
                i += 1
                continue
            open_ += (c == "(") - (c == ")")
            if open_ < 0:
                raise _Bad("unmatched parenthesis")
            out.append("\\z" if c == "$" else c)
            i += 1
    except _Bad:
        return None
    if open_:
        return None
    java = f"(?s{'i' if fold else ''})" + "".join(out)
    return java if _java_compiles(java) else None


def glob_to_java(p: str, fold: bool = False) -> str:
    """A whole-value pattern: * and ? cross slashes and leading dots, [!...] negates, a backslash escapes."""
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            try:
                piece, i = _bracket(p, i, "!^", escapes=True)
                out.append(piece)
                continue
            except _Bad:
                out.append("\\[")
        elif c == "\\" and i + 1 < len(p):
            i += 1
            out.append(_literal(p[i]))
        else:
            out.append(_literal(c))
        i += 1
    return f"(?s{'i' if fold else ''})\\A" + "".join(out) + "\\z"
