"""Queries to DataFrames.

select() is the plan to use: one scan of the metadata and at most one aggregation, whatever the filters. A query of one
filter on a named key needs no shuffle at all, since a key occurs once in an object. select_by_sets() states the same
result as set operations, filter by filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.predicates import matches
from vaultlens.plans.query import ANY_KEY, Filter, Query, parse


def condition(f: Filter, numeric: str = "index") -> Column:
    """Whether a metadata row satisfies a filter, before negation."""
    named = f.key != ANY_KEY
    test = matches(F.col("key"), F.col("value"), f.op, f.value, indexed=named and numeric == "index")
    return (F.col("key") == f.key) & test if named else test


def _fold(parts: list[Column], either: bool) -> Column:
    return reduce((lambda a, b: a | b) if either else (lambda a, b: a & b), parts)


def combined(q: Query, of) -> Column:
    groups = [(g, _fold([of(f) for f in fs], either)) for g, fs, either in ((0, q.of(0), q.any0), (1, q.of(1), q.any1)) if fs]
    return _fold([c for _, c in groups], q.any_group)


def flags(meta: DataFrame, q: Query, numeric: str = "index") -> DataFrame:
    """inode_id and one boolean f0, f1, ... for each filter, before negation, for every object with metadata."""
    each = [F.max(condition(f, numeric)).alias(f"f{i}") for i, f in enumerate(q.filters)]
    return meta.groupBy("inode_id").agg(*each)


def _positions(q: Query):
    at = {id(f): i for i, f in enumerate(q.filters)}
    return lambda f: ~F.col(f"f{at[id(f)]}") if f.negate else F.col(f"f{at[id(f)]}")


def select(meta: DataFrame, query: Query | str, numeric: str = "index") -> DataFrame:
    """inode_id of every object that the query selects."""
    q = parse(query) if isinstance(query, str) else query
    if len(q.filters) == 1 and not q.filters[0].negate:
        f = q.filters[0]
        hits = meta.where(condition(f, numeric)).select("inode_id")
        return hits if f.key != ANY_KEY else hits.distinct()
    if all(f.key != ANY_KEY and not f.negate for f in q.filters):
        meta = meta.where(F.col("key").isin(sorted({f.key for f in q.filters})))
    return flags(meta, q, numeric).where(combined(q, _positions(q))).select("inode_id")


def select_by_sets(meta: DataFrame, query: Query | str, numeric: str = "index") -> DataFrame:
    q = parse(query) if isinstance(query, str) else query
    universe = meta.select("inode_id").distinct()

    def ids(f: Filter) -> DataFrame:
        hits = meta.where(condition(f, numeric)).select("inode_id").distinct()
        return universe.join(hits, "inode_id", "left_anti") if f.negate else hits

    def put(sets: list[DataFrame], either: bool) -> DataFrame:
        return reduce((lambda a, b: a.union(b).distinct()) if either else (lambda a, b: a.intersect(b)), sets)

    groups = [put([ids(f) for f in fs], either) for fs, either in ((q.of(0), q.any0), (q.of(1), q.any1)) if fs]
    return put(groups, q.any_group)


def count(meta: DataFrame, query: Query | str, numeric: str = "index") -> DataFrame:
    """n: matching objects, also those that no catalogue entry names."""
    return select(meta, query, numeric).agg(F.count(F.lit(1)).alias("n"))


def explain(meta: DataFrame, query: Query | str, numeric: str = "index") -> DataFrame:
    """step, n: matches of each filter, after NOT, of each group and of the whole, in one pass."""
    q = parse(query) if isinstance(query, str) else query
    of = _positions(q)
    steps: list[tuple[str, Column]] = []
    for i, f in enumerate(q.filters):
        steps.append((f"filter{i}", F.col(f"f{i}")))
        if f.negate:
            steps.append((f"not{i}", ~F.col(f"f{i}")))
    for g, either in ((0, q.any0), (1, q.any1)):
        if q.of(g):
            steps.append((f"group{g}", _fold([of(f) for f in q.of(g)], either)))
    steps.append(("result", combined(q, of)))
    row = flags(meta, q, numeric).agg(*[F.count_if(c).alias(name) for name, c in steps])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("step"), F.col(name).alias("n")) for name, _ in steps])).alias("s")).select("s.step", "s.n")
