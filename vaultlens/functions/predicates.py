"""The 29 predicates on metadata values."""

from __future__ import annotations

from collections.abc import Callable
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultlens.functions.patterns import ere_to_java, glob_to_java
from vaultlens.functions.scalar import INT_MAX, INT_MIN, ascii_lower, is_whole_int, parts, strtoll


class Op(IntEnum):
    """The ids of the query language's operators."""

    EQ = 0
    NE = 1
    GT = 2
    LT = 3
    GE = 4
    LE = 5
    CONTAINS = 6
    STARTSWITH = 7
    EXISTS = 8
    IEQ = 9
    INE = 10
    ICONTAINS = 11
    ISTARTSWITH = 12
    NEQ = 13
    NNE = 14
    NGT = 15
    NLT = 16
    NGE = 17
    NLE = 18
    REGEX = 19
    IREGEX = 20
    ENDSWITH = 21
    IENDSWITH = 22
    IN = 23
    IIN = 24
    BETWEEN = 25
    NBETWEEN = 26
    GLOB = 27
    IGLOB = 28


#: Operators that must hold for every value of a multi-value; the others need one.
ALL_VALUES = {Op.NE, Op.INE}
#: Operators that a numeric index answers.
INDEXED = {Op.NEQ, Op.NGT, Op.NLT, Op.NGE, Op.NLE, Op.NBETWEEN}


def parse_int(text: str) -> int:
    """strtoll() for literals."""
    t = text.lstrip(" \t\n\x0b\f\r")
    sign, digits = (-1 if t[:1] == "-" else 1), t[1:] if t[:1] in ("+", "-") else t
    n = 0
    for c in digits:
        if c not in "0123456789":
            break
        n = n * 10 + int(c)
    return max(INT_MIN, min(INT_MAX, sign * n))


def members(literal: str) -> list[str]:
    """Items of an IN list: a trailing empty one never matches, others may be empty."""
    items = literal.split(",")
    return items[:-1] if items[-1] == "" else items


def bounds(literal: str) -> tuple[str, str] | None:
    low, comma, high = literal.partition(",")
    return (low, high) if comma else None


def _number_range(op: Op, literal: str) -> tuple[int, int] | None:
    """The closed range of numbers that an indexed predicate accepts; at the ends of the type > means >= and < means <=."""
    if op == Op.NBETWEEN:
        b = bounds(literal)
        return (parse_int(b[0]), parse_int(b[1])) if b else None
    n = parse_int(literal)
    return {Op.NEQ: (n, n), Op.NGT: (min(n, INT_MAX - 1) + 1, INT_MAX), Op.NGE: (n, INT_MAX), Op.NLT: (INT_MIN, max(n, INT_MIN + 1) - 1), Op.NLE: (INT_MIN, n)}[op]


def scalar_test(op: Op, literal: str) -> Callable[[Column], Column]:
    """The test of one value."""
    f, low = F.lit(literal), F.lit(literal.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    never = F.lit(False)

    def pattern(java: str | None) -> Callable[[Column], Column]:
        return (lambda v: v.rlike(java)) if java is not None else (lambda v: never)

    def between() -> Callable[[Column], Column]:
        b = bounds(literal)
        return (lambda v: v.between(F.lit(b[0]), F.lit(b[1]))) if b else (lambda v: never)

    def numbers() -> Callable[[Column], Column]:
        n = parse_int(literal)
        if op == Op.NBETWEEN:
            b = bounds(literal)
            return (lambda v: strtoll(v).between(parse_int(b[0]), parse_int(b[1]))) if b else (lambda v: never)
        return {Op.NEQ: lambda v: strtoll(v) == n, Op.NNE: lambda v: strtoll(v) != n, Op.NGT: lambda v: strtoll(v) > n, Op.NLT: lambda v: strtoll(v) < n, Op.NGE: lambda v: strtoll(v) >= n, Op.NLE: lambda v: strtoll(v) <= n}[op]

    simple: dict[Op, Callable[[Column], Column]] = {
        Op.EQ: lambda v: v == f,
        Op.NE: lambda v: v != f,
        Op.GT: lambda v: v > f,
        Op.LT: lambda v: v < f,
        Op.GE: lambda v: v >= f,
        Op.LE: lambda v: v <= f,
        Op.CONTAINS: lambda v: F.contains(v, f),
        Op.STARTSWITH: lambda v: F.startswith(v, f),
        Op.EXISTS: lambda v: F.lit(True),
        Op.IEQ: lambda v: ascii_lower(v) == low,
        Op.INE: lambda v: ascii_lower(v) != low,
        Op.ICONTAINS: lambda v: F.contains(ascii_lower(v), low),
        Op.ISTARTSWITH: lambda v: F.startswith(ascii_lower(v), low),
        Op.ENDSWITH: lambda v: F.endswith(v, f),
        Op.IENDSWITH: lambda v: F.endswith(ascii_lower(v), low),
        Op.IN: lambda v: v.isin(members(literal)),
        Op.IIN: lambda v: ascii_lower(v).isin(members(literal.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))),
    }
    if op in simple:
        return simple[op]
    if op == Op.BETWEEN:
        return between()
    if op in (Op.REGEX, Op.IREGEX):
        return pattern(ere_to_java(literal, fold=op == Op.IREGEX))
    if op in (Op.GLOB, Op.IGLOB):
        return pattern(glob_to_java(literal, fold=op == Op.IGLOB))
    return numbers()


def matches(key: Column, value: Column, op: Op, literal: str, indexed: bool = False) -> Column:
    """Whether a row's value satisfies the predicate; indexed: as a numeric index answers, where it can."""
    if op == Op.EXISTS:
        return F.lit(True)
    if indexed and op in INDEXED:
        span = _number_range(op, literal)
        return is_whole_int(value) & strtoll(value).between(*span) if span else F.lit(False)
    test = scalar_test(op, literal)
    several = F.contains(value, F.lit("\n")) & (key != "Comments")
    lines = parts(key, value)
    many = F.forall(lines, test) if op in ALL_VALUES else F.exists(lines, test)
    return F.when(several, many).otherwise(test(value))
