"""Benchmark decontamination: which documents hold a benchmark item.

A document holds an item if at least THRESHOLD of the item's distinct five-word shingles stand in it. Words are runs
without white space, ASCII letters in lower case. Items are partitioned by size (powers of two of their number of
shingles). An item's MinHash sketch is the shingles with the smallest hashes, so many that a document that misses all
of them cannot reach the threshold: floor((1 - THRESHOLD) n) + 1. So the search has no false negatives. Each partition's
largest sketch hash bounds the hashes by which documents are probed for its items, and probes meet the sketches of their
own partition only: short items, whose sketches reach up to almost any hash, don't widen the search for long ones.
Hashes above every bound never leave the array. Candidate pairs are then verified by exact containment of shingles, in the documents named by the search.

Sketches, and the shingles of candidate items, are broadcast only while the benchmark has at most BROADCAST_ROWS of
them (counted first); beyond that the same joins shuffle.

Defined results: a text of fewer than five words has one shingle, all its words; null and blank texts hold nothing, and
null and blank items are held by nothing; rows that repeat an id, or have none, are judged each by its own text (known by
its hash), and reported under that id; items of equal text are each reported; empty tables give an empty result; extra columns pass through the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import ascii_lower, cut, fresh, let, sized, words

WIDTH = 5
THRESHOLD = (4, 5)
#: Rows of (hash, item, size), some 40 bytes each, that are still broadcast.
BROADCAST_ROWS = 500_000


def _shingles(text: Column) -> Column:
    """Distinct shingles as strings."""

    def of(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(WIDTH)]))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= WIDTH, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(each))

    return let(words(ascii_lower(text)), of)


def _probes(text: Column, bounds: dict[int, int]) -> Column:
    """part, h: shingle hashes, once for each size partition whose bound they do not exceed."""
    most = max(bounds.values())

    def of(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(WIDTH)])))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.filter(F.when(n <= WIDTH, one).otherwise(each), lambda h: h <= most))

    def up_to(hs: Column, part: int, bound: int) -> Column:
        return F.transform(F.filter(hs, lambda h: h <= bound), lambda h: F.struct(F.lit(part).alias("part"), h.alias("h")))

    def dealt(hs: Column) -> Column:
        return F.concat(*[up_to(hs, k, b) for k, b in sorted(bounds.items())])

    return let(let(words(ascii_lower(text)), of), dealt)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _held(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """doc_id, t (the hash of its text), item_id, n_shared, n_item: every pair at or above the threshold."""
    num, den = THRESHOLD
    sets = items.select(F.col(item_id).alias("item_id"), _shingles(F.col(item_text)).alias("shingles")).where(F.size("shingles") > 0).distinct()
    n = F.size("shingles")
    by_hash = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s)))
    sketch = F.slice(by_hash, F.lit(1), F.floor(n * (den - num) / den).cast("int") + 1)
    # Items are known by a number, which stands once the table is stored.
    prepared = cut(sets.select(F.monotonically_increasing_id().alias("item"), "item_id", "shingles", n.alias("n"), F.floor(F.log2(n)).cast("int").alias("part"), sketch.alias("sketch")))
    # One bound of each size partition; sizes up to 2^31 make at most 32 partitions.
    bounds = prepared.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("most"), F.sum(F.size("sketch")).alias("rows"), F.sum("n").alias("all")).collect()
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    if not bounds:
        return keyed.select("doc_id", "t", F.lit(0).cast(prepared.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_item")).limit(0)
    sketches = prepared.select("part", "item", F.explode("sketch").alias("h"))
    probes = keyed.select("doc_id", "t", F.explode(_probes(F.col("text"), {b["part"]: b["most"] for b in bounds})).alias("p")).select("doc_id", "t", "p.part", "p.h")
    found = probes.join(_small(sketches, sum(b["rows"] for b in bounds)), ["part", "h"]).groupBy("doc_id", "t", "item").agg(F.count(F.lit(1)).alias("_"))
    # The rows that the search names; while they are few, no text is shuffled to verify them.
    listed = sized(found.groupBy("doc_id", "t").agg(F.collect_set("item").alias("wanted")).select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "wanted"), weight=F.size("wanted") / 4)
    texts = keyed.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")))
    exact = prepared.select("item", "item_id", "n", "shingles")
    pairs = texts.select("doc_id", "t", F.explode("wanted").alias("item"), _shingles(F.col("text")).alias("held"))
    shared = F.size(F.array_intersect("held", "shingles"))
    out = pairs.join(_small(exact, sum(b["all"] for b in bounds)), "item").select("doc_id", "t", "item_id", shared.alias("n_shared"), F.col("n").alias("n_item"))
    return out.where(den * F.col("n_shared") >= num * F.col("n_item"))


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item: every pair at or above the threshold."""
    return _held(docs, items, doc_id, text, item_id, item_text).drop("t").distinct()


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, each judged by its own text."""
    d, t = fresh(docs, "_held", "_t")
    held = sized(_held(docs, items, doc_id, text, item_id, item_text).select(F.col("doc_id").alias(d), F.col("t").alias(t)).distinct())
    return docs.join(held, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left_anti")
