"""Line dedup: lines within one word edit of an earlier line go; the earliest stays.

Two lines are near if one word inserted, deleted or replaced makes them equal and the longer has MIN_WORDS words or
more (five, so they are at least 0.8 alike). Equal lines are near at any length. Words are runs without white space,
so spacing does not matter; lines without a word always stay.

1. Each line is reduced to a 128-bit hash, its place (document, line) and two to four short keys; texts stay behind.
   Equal lines are merged: from here on a line is known by its first place.
2. One word edit leaves either the first or the last k words alone, so near lines share a key: the hash of their first
   or last k words, with k about half their length. Keys are aggregated (least and greatest line), not paired; lines
   whose keys all belong to one line have no neighbour and are done.
3. The others' deletion neighbourhood: for each place in the line, the hashes of all words before it and of all words
   after it, once with the word there left out (deletion), once with none left out (insertion). Lines that share such
   a pair of hashes are within one edit of each other, all of them, so each group is reduced to its earliest line by
   an aggregation, and a line is held against that one only. The number of links is linear in a group's size.
   Of a line that shares its first half only places after that half are varied, and likewise for the last half.
4. Each link's edit distance is verified on the words themselves.
5. A line goes if it is not the first place of its hash, or has a verified link to an earlier line.

Hashes of all starts of a line are made from hashes of whole blocks of words and of the words since the last block, so
a line of any length costs a number of operations linear in its words. Tables that steer a join (keys that are shared,
places of lines, lines that go) are stored and counted; up to BROADCAST_ROWS they are broadcast, beyond that shuffled.
Of the aggregations over all keys few rows are left, so these are dealt out anew before they are stored: a file for each
partition that they came from would be hundreds of small ones.

Rows that share an id, or have none, are told apart by a hash of their text, so a line goes only from rows that hold it.

Defined results: null and empty texts stay as they are; ties in place (repeated document ids) count as one place, so
lines there never remove each other, but each is searched for near ones elsewhere; null ids sort first; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import SPACE_CHARS, fresh, let, n_words, single_spaced, sized, stored

MIN_WORDS = 5
#: Words hashed as one block.
BLOCK = 32


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d, i, t (the hash of the whole text), line: every line with a word."""
    split = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    return split.where(F.btrim("line", F.lit(SPACE_CHARS)) != "")


def _half_keys(s: Column, n: Column) -> Column:
    """Hashes of the first (side 0) and last (side 1) k words, for the one or two k that a line of n words shares with one of n + 1 or n - 1."""

    def both(k: Column) -> list[Column]:
        of = [(0, F.call_function("substring_index", s, F.lit(" "), k)), (1, F.call_function("substring_index", s, F.lit(" "), -k))]
        return [F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side), half, k).alias("key")) for side, half in of]

    low, high = F.shiftright(n, 1) - 1, F.shiftright(n + 1, 1) - 1
    none = F.array().cast("array<struct<side:int,key:bigint>>")
    return F.when(n < MIN_WORDS - 1, none).when(low == high, F.array(*both(low))).otherwise(F.array(*both(low), *both(high)))


def _starts(words: Column) -> Column:
    """Hashes of the first 0, 1, ... n words."""

    def of(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / BLOCK).cast("int")), lambda b: F.array_join(F.slice(w, b * BLOCK + 1, F.lit(BLOCK)), " "))
        blocks = F.aggregate(full, F.array(F.lit(0).cast("long")), lambda acc, text: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), text))))

        def at(i: Column, done: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.xxhash64(F.get(done, b), F.array_join(F.slice(w, b * BLOCK + 1, i - b * BLOCK), " "), i)

        return let(blocks, lambda done: F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: at(i, done)))

    return let(words, of)


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """k1, k2, p for every deletion and insertion of the lines (p, s, sides: the halves it shares)."""
    words = F.split("s", " ")
    made = lines.select("p", "sides", F.size(words).alias("n"), _starts(words).alias("front"), _starts(F.reverse(words)).alias("back"))
    n, half = F.col("n"), F.shiftright(F.col("n"), 1) - 1

    def places(last: Column) -> Column:
        every = F.sequence(F.lit(0), last)
        return F.filter(every, lambda i: (F.array_contains("sides", 0) & (i >= half)) | (F.array_contains("sides", 1) & (i <= n - half)))

    def key(i: Column, after: Column) -> Column:
        return F.struct(F.get(F.col("front"), i).alias("k1"), F.get(F.col("back"), after).alias("k2"))

    keys = F.concat(F.transform(places(n - 1), lambda i: key(i, n - 1 - i)), F.transform(places(n), lambda i: key(i, n - i)))
    return made.select("p", F.explode(keys).alias("k")).select("p", "k.k1", "k.k2")


def _within_one(x: Column, y: Column) -> Column:
    """Whether one word edit at most leads from one array to the other: what they share at the start and at the end leaves one word."""

    def shared(a: Column, b: Column) -> Column:
        at = F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, F.greatest(F.size(a), F.size(b))).otherwise(at - 1)

    return shared(x, y) + shared(F.reverse(x), F.reverse(y)) >= F.greatest(F.size(x), F.size(y)) - 1


def _linked(variants: DataFrame) -> DataFrame:
    """p, e: lines with the earliest line of a group they are in."""
    groups = sized(variants.groupBy("k1", "k2").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").hint("rebalance"))
    two = groups.where("n = 2").select(F.col("hi").alias("p"), F.col("lo").alias("e"))
    more = variants.join(groups.where("n > 2").select("k1", "k2", "lo"), ["k1", "k2"]).where("p <> lo").select("p", F.col("lo").alias("e"))
    return two.unionByName(more).distinct()


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, i, t: the places of the lines that go, and the hash of their text."""
    lines = _lines(docs, doc_id, text)
    place = F.struct("d", "i", "t")

    def apart(x: Column, y: Column) -> Column:
        return F.struct(x["d"], x["i"]) != F.struct(y["d"], y["i"])

    spaced = lines.select("d", "i", "t", single_spaced(F.col("line")).alias("s"))
    hashed = spaced.select("d", "i", "t", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("second"), F.col("s")).alias("h2"), "s", n_words(F.col("s")).alias("n"))
    marked = stored(hashed.select("d", "i", "t", "h1", "h2", _half_keys(F.col("s"), F.col("n")).alias("keys")))
    first = stored(marked.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("times"), F.first("keys").alias("keys")))

    keyed = first.select("p", F.explode("keys").alias("k")).select("p", "k.side", "k.key")
    shared = sized(keyed.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo <> hi").select("key").hint("rebalance"))
    near = sized(keyed.join(shared, "key", "left_semi").groupBy("p").agg(F.collect_set("side").alias("sides")).select("p.d", "p.i", "p.t", "sides"))

    found = lines.join(near, lines["d"].eqNullSafe(near["d"]) & (lines["i"] == near["i"]) & (lines["t"] == near["t"])).select(F.struct(lines["d"], lines["i"], lines["t"]).alias("p"), "sides", single_spaced(F.col("line")).alias("s"))
    texts = stored(found.groupBy("p").agg(F.min("s").alias("s"), F.first("sides").alias("sides")))
    pairs = _linked(_neighbourhood(texts))
    x = texts.select("p", F.split("s", " ").alias("x"))
    y = texts.select(F.col("p").alias("e"), F.split("s", " ").alias("y"))
    verified = pairs.where(apart(F.col("p"), F.col("e"))).join(x, "p").join(y, "e").where((F.greatest(F.size("x"), F.size("y")) >= MIN_WORDS) & _within_one(F.col("x"), F.col("y")))
    gone = verified.select("p", F.lit(True).alias("all")).distinct()

    decided = first.select("h1", "h2", "p", "times").join(gone, "p", "left").where("all OR times > 1").select("h1", "h2", "p", F.coalesce("all", F.lit(False)).alias("all"))
    out = marked.select("h1", "h2", place.alias("at")).join(sized(decided), ["h1", "h2"]).where(F.col("all") | apart(F.col("at"), F.col("p")))
    return out.select("at.d", "at.i", "at.t").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines that go, with n_lines (lines with a word before) and n_removed added."""
    d, t, gone, total, removed = fresh(docs, "_d", "_t", "_gone", "n_lines", "n_removed")
    by_row = sized(removals(docs, doc_id, text).groupBy("d", "t").agg(F.collect_set("i").alias(gone)).withColumnsRenamed({"d": d, "t": t}), weight=F.size(gone) / 8)
    joined = docs.join(by_row, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left").drop(d, t)
    # The places that stay are found with hash sets, so a text of many lines costs no more than its lines.
    lines = F.split(F.col(text), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = let(lines, lambda ls: F.array_join(F.transform(keep, lambda i: F.get(ls, i)), "\n"))
    with_word = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    return joined.withColumns({total: F.coalesce(with_word, F.lit(0)).cast("long"), removed: F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long"), text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)}).drop(gone)
