"""URL filter: a trie over reversed host labels, then path segments; the deepest entry decides between allow and block.

The trie is shipped to the workers. Its size is the rule table's, not the corpus's; url_verdicts() sends it up to
MAX_RULES rules, and URLs are judged row by row, with no shuffle. Larger tables go through joined_verdicts(), which
joins the different (host, path) of the URLs with the rules and gives the same results.

Defined results: null URLs and those without "://" have an empty host and path and no rule; where no rule fits, the
verdict is `default`; repeated rows are judged alike; extra columns pass through (columns named host, path, rule or verdict are replaced); of two entries for the same host
and path the later one counts; an empty rule table gives the default everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import ascii_lower, fresh

#: Rules above which the trie isn't broadcast (some 200 bytes each).
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # allow or block


class Trie:
    """Nodes are dictionaries; the key "" of a host node leads to its path trie, None to the last parts of rules' paths."""

    def __init__(self, rules: Iterable[UrlRule]) -> None:
        self.root: dict = {}
        for r in rules:
            node = self.root
            for label in reversed(r.host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {})
            *segments, rest = r.path.split("/")
            for s in segments:
                node = node.setdefault(s, {})
            node.setdefault(None, {})[rest] = (f"{r.host}{r.path}", r.verdict)
        self._measure(self.root)

    def _measure(self, root: dict) -> None:
        """Beside each node's last parts (key None) their different lengths, longest first (key 0)."""
        todo = [root]
        while todo:
            node = todo.pop()
            if None in node:
                node[0] = sorted({len(k) for k in node[None]}, reverse=True)
            todo += [v for k, v in node.items() if k not in (None, 0)]

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        """The longest entry whose path starts this one: whole segments, then the start of what follows, looked up once for each length that entries there have."""
        best, at = None, 0
        while True:
            last = node.get(None)
            if last:
                for n in node[0]:
                    if at + n <= len(path) and (got := last.get(path[at : at + n])):
                        best = got
                        break
            cut = path.find("/", at)
            node = node.get(path[at:cut]) if cut >= 0 else None
            if node is None:
                return best
            at = cut + 1

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            if "" in node:
                best = self._path(node[""], path) or best
        return best


def build_trie(rules: Iterable[UrlRule], limit: int = MAX_RULES) -> Trie:
    rules = list(rules)
    if len(rules) > limit:
        raise ValueError(f"{len(rules)} rules; a trie of more than {limit} isn't broadcast")
    return Trie(rules)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """As the URL writes them; the host in ASCII lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    whole = F.regexp_extract(rest, "(?s)^([^?#]*)", 1)
    host = F.substring_index(whole, "/", 1)
    path = F.substring(whole, F.length(host) + 1, F.length(whole))
    return ascii_lower(host), path


def url_verdicts(spark, df, url: str, rules: Iterable[UrlRule], default: str = "allow"):
    """df with host, path, rule and verdict."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        rows = [(k, r.host, r.path, r.verdict) for k, r in enumerate(rules)]
        return joined_verdicts(df, url, spark.createDataFrame(rows, "place long, host string, path string, verdict string"), default)
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for host, path in parts:
            found = [find(h, p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame({"rule": [f[0] if f else None for f in found], "verdict": [f[1] if f else default for f in found]}, dtype=object)

    host, path = host_and_path(F.col(url))
    judged = fresh(df, "_judged")[0]
    out = df.withColumns({"host": host, "path": path}).withColumn(judged, judge("host", "path"))
    return out.withColumns({"rule": F.col(judged)["rule"], "verdict": F.col(judged)["verdict"]}).drop(judged)


def joined_verdicts(df: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """url_verdicts() for a rule table (place, host, path, verdict) of any size; of equal entries the one of the greatest place counts.

    Every different (host, path) is looked up by its host's suffixes of whole labels and its path's beginnings of the
    lengths that rules have. Rules are unique by key, so a lookup finds one row, and skewed keys are split by the join.
    """
    host, path = host_and_path(F.col(url))
    out = df.withColumns({"host": host, "path": path})
    unique = rules.select("place", F.col("host").alias("own"), ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    unique = unique.groupBy("h", "p").agg(F.max_by(F.struct(F.concat("own", "p").alias("rule"), F.col("v").alias("verdict")), "place").alias("found"))
    # One number for each length that a rule's path has; URLs bound them.
    sizes = sorted(r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = out.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("h"), starts.alias("ps")).where("h <> ''")
    asked = asked.select("host", "path", "h", F.explode("ps").alias("p"))
    best = asked.join(unique, ["h", "p"]).groupBy("host", "path").agg(F.max_by("found", F.struct(F.length("h"), F.length("p"))).alias("found"))
    judged, h, p = fresh(out, "_judged", "_host", "_path")
    both = out.join(best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("found").alias(judged)), (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return both.withColumns({"rule": F.col(judged)["rule"], "verdict": F.coalesce(F.col(judged)["verdict"], F.lit(default))}).drop(judged, h, p)
