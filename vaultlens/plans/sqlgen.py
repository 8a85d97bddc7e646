"""The query language in DuckDB SQL: an independent statement of each query as set operations over the long table."""

from __future__ import annotations

from vaultlens.functions.predicates import ALL_VALUES, INDEXED, Op, bounds, members, parse_int
from vaultlens.functions.scalar import INT_MAX, INT_MIN, LOWER, UPPER
from vaultlens.plans.query import ANY_KEY, Filter, Query, parse


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(s: str) -> str:
    return f"translate({s}, '{UPPER}', '{LOWER}')"


def strtoll(v: str) -> str:
    x = rf"regexp_extract({v}, '^[ \t\n\v\f\r]*([+-]?[0-9]+)', 1)"
    number = f"try_cast(nullif(ltrim({x}, '+'), '') AS HUGEINT)"
    over = f"CASE WHEN {x} = '' THEN 0 WHEN starts_with({x}, '-') THEN {INT_MIN} ELSE {INT_MAX} END"
    return f"CAST(greatest(least(coalesce({number}, {over}), {INT_MAX}), {INT_MIN}) AS BIGINT)"


def whole(v: str) -> str:
    return rf"regexp_matches({v}, '^[ \t\n\v\f\r]*[+-]?[0-9]+\z')"


def parts(key: str, value: str) -> str:
    return rf"CASE WHEN {key} = 'Comments' OR instr({value}, chr(10)) = 0 THEN [{value}] ELSE string_split(regexp_replace({value}, '\n\z', ''), chr(10)) END"


def listed(key: str, value: str) -> str:
    return f"list_filter(CASE WHEN {key} = 'Comments' THEN [{value}] ELSE string_split({value}, chr(10)) END, lambda x: x <> '')"


def test(op: Op, literal: str, v: str) -> str:
    f, low = quoted(literal), fold(quoted(literal))
    n = parse_int(literal) if op not in (Op.BETWEEN, Op.NBETWEEN) else 0
    b = bounds(literal) or ("", "")
    items = ", ".join(map(quoted, members(literal)))
    return {
        Op.EQ: f"{v} = {f}", Op.NE: f"{v} <> {f}", Op.GT: f"{v} > {f}", Op.LT: f"{v} < {f}", Op.GE: f"{v} >= {f}", Op.LE: f"{v} <= {f}",
        Op.CONTAINS: f"contains({v}, {f})", Op.STARTSWITH: f"starts_with({v}, {f})", Op.ENDSWITH: f"ends_with({v}, {f})", Op.EXISTS: "true",
        Op.IEQ: f"{fold(v)} = {low}", Op.INE: f"{fold(v)} <> {low}", Op.ICONTAINS: f"contains({fold(v)}, {low})", Op.ISTARTSWITH: f"starts_with({fold(v)}, {low})", Op.IENDSWITH: f"ends_with({fold(v)}, {low})",
        Op.NEQ: f"{strtoll(v)} = {n}", Op.NNE: f"{strtoll(v)} <> {n}", Op.NGT: f"{strtoll(v)} > {n}", Op.NLT: f"{strtoll(v)} < {n}", Op.NGE: f"{strtoll(v)} >= {n}", Op.NLE: f"{strtoll(v)} <= {n}",
        Op.REGEX: f"regexp_matches({v}, {f}, 's')", Op.IREGEX: f"regexp_matches({v}, {f}, 'si')",
        Op.IN: f"{v} IN ({items})", Op.IIN: f"{fold(v)} IN ({items.translate(str.maketrans(UPPER, LOWER))})",
        Op.BETWEEN: f"{v} BETWEEN {quoted(b[0])} AND {quoted(b[1])}", Op.NBETWEEN: f"{strtoll(v)} BETWEEN {parse_int(b[0])} AND {parse_int(b[1])}",
        Op.GLOB: f"{v} GLOB {f}", Op.IGLOB: f"{fold(v)} GLOB {low}",
    }[op]


def condition(f: Filter, numeric: str) -> str:
    if f.key != ANY_KEY and numeric == "index" and f.op in INDEXED:
        c = f"({whole('value')} AND {test(f.op, f.value, 'value')})"
    elif f.op in ALL_VALUES:
        c = f"len(list_filter({parts('key', 'value')}, lambda v: NOT ({test(f.op, f.value, 'v')}))) = 0"
    else:
        c = f"len(list_filter({parts('key', 'value')}, lambda v: {test(f.op, f.value, 'v')})) > 0"
    return c if f.key == ANY_KEY else f"key = {quoted(f.key)} AND {c}"


def select(meta: str, query: str | Query, numeric: str = "index") -> str:
    """SQL for the inode_id of what a query selects from the long table that `meta` gives."""
    q = parse(query) if isinstance(query, str) else query

    def ids(f: Filter) -> str:
        hits = f"SELECT DISTINCT inode_id FROM meta WHERE {condition(f, numeric)}"
        return f"(SELECT DISTINCT inode_id FROM meta EXCEPT {hits})" if f.negate else f"({hits})"

    def put(sets: list[str], either: bool) -> str:
        return "(" + (" UNION " if either else " INTERSECT ").join(sets) + ")"

    groups = [put([ids(f) for f in fs], either) for fs, either in ((q.of(0), q.any0), (q.of(1), q.any1)) if fs]
    return f"WITH meta AS MATERIALIZED ({meta}) SELECT inode_id FROM {put(groups, q.any_group)}"
