"""The query language: text to a plain description of a query.

A query is up to four filters in at most two groups: those outside and those inside one pair of parentheses. One
combiner (AND or OR) holds within each group and one between the groups; there is no precedence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from vaultlens.functions.predicates import Op

MAX_FILTERS = 4
MAX_VALUE = 1024
ANY_KEY = "*"
#: Operator words and signs, those that are read first in front.
_SIGNS = {"!=": Op.NE, ">=": Op.GE, "<=": Op.LE, "=": Op.EQ, ">": Op.GT, "<": Op.LT}
_NUMBER_SIGNS = {"N!=": Op.NNE, "N>=": Op.NGE, "N<=": Op.NLE, "N=": Op.NEQ, "N>": Op.NGT, "N<": Op.NLT}
_FOLD_SIGNS = {"I!=": Op.INE, "I=": Op.IEQ}
_WORDS = {op.name: op for op in Op if op.name.isalpha() and op.name not in {"EQ", "NE", "GT", "LT", "GE", "LE", "IEQ", "INE", "NEQ", "NNE", "NGT", "NLT", "NGE", "NLE"}}
_TWO = {Op.BETWEEN, Op.NBETWEEN}
_TOKEN = re.compile(r'[^ \t"=!<>*()]+|\*')


class QueryError(ValueError):
    """The text is not a query."""


@dataclass(frozen=True)
class Filter:
    key: str
    op: Op
    value: str = ""
    negate: bool = False
    group: int = 0


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...]
    any0: bool = False  # OR within group 0
    any1: bool = False  # OR within group 1
    any_group: bool = False  # OR between the groups

    def of(self, group: int) -> tuple[Filter, ...]:
        return tuple(f for f in self.filters if f.group == group)


@dataclass
class _Scanner:
    text: str
    at: int = 0
    seen: dict[str, bool] = field(default_factory=dict)

    def space(self) -> str:
        while self.text[self.at : self.at + 1] in (" ", "\t") and self.at < len(self.text):
            self.at += 1
        return self.text[self.at : self.at + 1]

    def token(self) -> str | None:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[0]

    def quoted(self) -> str:
        m = re.compile(r'"((?:\\["\\]|[^"])*)"', re.S).match(self.text, self.at)
        if not m:
            raise QueryError("unterminated quoted string")
        self.at = m.end()
        return re.sub(r'\\(["\\])', r"\1", m[1])

    def operator(self) -> Op:
        rest = self.text[self.at :]
        for table in (_NUMBER_SIGNS, _FOLD_SIGNS, _SIGNS):
            for sign, op in table.items():
                if rest[: len(sign)].upper() == sign:
                    self.at += len(sign)
                    return op
        word = self.token()
        op = _WORDS.get((word or "").upper())
        if op is None:
            raise QueryError(f"unknown operator at {rest[:20]!r}")
        return op

    def value(self) -> str:
        if self.space() == '"':
            return self.quoted()
        word = self.token()
        if word is None:
            raise QueryError("expected a value after the operator")
        return word

    def filter(self) -> Filter:
        self.space()
        key = self.token()
        if key is None:
            raise QueryError("expected a key name")
        self.space()
        op = self.operator()
        if op == Op.EXISTS:
            return Filter(key, op)
        value = self.value()
        if op in _TWO:
            second = self.value()
            if len(value.encode()) + 1 + len(second.encode()) <= MAX_VALUE:
                value = f"{value},{second}"
        return Filter(key, op, value)

    def negated(self) -> bool:
        start = self.at
        word = self.token()
        if word is not None and word.upper() == "NOT" and self.space() not in ("", "=", "!", ">", "<", ")"):
            return True
        self.at = start
        return False

    def combiner(self, slot: str, word: str) -> None:
        either = word.upper() == "OR"
        if self.seen.setdefault(slot, either) != either:
            raise QueryError("AND and OR cannot be mixed on one level")


def parse(text: str) -> Query:
    s, filters, inside, closed_once = _Scanner(text), [], False, False
    while True:
        if len(filters) >= MAX_FILTERS:
            raise QueryError(f"more than {MAX_FILTERS} filters")
        c = s.space()
        if not c:
            if not filters:
                raise QueryError("expected a filter condition")
            break
        if c == "(":
            if inside or closed_once:
                raise QueryError("only one group of parentheses, not nested")
            inside, closed_once = True, True
            s.at += 1
            s.space()
        negate = s.negated()
        filters.append(replace(s.filter(), negate=negate, group=int(inside)))
        after_group = False
        if s.space() == ")":
            if not inside:
                raise QueryError("unexpected )")
            inside, after_group = False, True
            s.at += 1
        if not s.space():
            break
        word = s.token()
        if word is None or word.upper() not in ("AND", "OR"):
            raise QueryError("expected AND or OR between filters")
        s.combiner("between" if after_group or s.space() == "(" else "inside" if inside else "outside", word)
    if inside:
        raise QueryError("unclosed parenthesis")
    between = s.seen.get("between", False)
    return Query(tuple(filters), any0=s.seen.get("outside", between), any1=s.seen.get("inside", False), any_group=between)
