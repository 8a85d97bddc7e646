"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, connected components.

Fingerprints are made text by text in numpy. Equal ones are merged first (one node, the fingerprint itself, for any
number of copies), so ids that repeat or are missing neither link nor part anything. A fingerprint is cut into BLOCKS parts; two that differ in at most MAX_BITS bits agree in all parts but
MAX_BITS, so for each choice of parts to keep, equal kept bits make a bucket. Buckets are counted before anything is
gathered: a bucket of two is a pair; one of up to BUCKET nodes is searched in one task, which returns links that span
what it connects, never all pairs; nodes of larger buckets go to finer buckets (FINE equal parts of four bits, so 12 bits
are free and no bucket can hold more than 4,096 distinct fingerprints). Nothing is capped or dropped.

Defined results: null and empty texts have the fingerprint zero, which links like any other; texts of one or two
words have one shingle, the whole text; a null id is a document like any other and sorts last (it names a component
only if no row there has an id); repeated rows share a component; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.llm.common import cut, fresh, ship, sized
from vaultlens.llm.components import components

MAX_BITS = 3
BLOCKS = 6
FINE = 16
BUCKET = 2048
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Hashes whose bits are spread out at a time.
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is set if more than half of the shingles' XXH64 (seed 42) have it set."""
    if not text:
        return 0
    ws = _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_FOLD))
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[: len(ws) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(ws) - width + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *also: str) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long) and the columns of also."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("id"), fp(F.col(text)).alias("fp"), *also)


def _bounds(parts: int) -> list[tuple[int, int]]:
    at = [round(64 * k / parts) for k in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(at, at[1:], strict=False)]


def _masks(parts: int) -> list[int]:
    """For each choice of parts that may differ, the bits that must agree, as signed longs."""
    out = []
    for free in combinations(_bounds(parts), MAX_BITS):
        m = (1 << 64) - 1
        for lo, n in free:
            m &= ~(((1 << n) - 1) << lo)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _keys(nodes: DataFrame, parts: int) -> DataFrame:
    """fp, id, mask number and the bits kept, once for each mask."""
    kept = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(parts))])
    return nodes.select("fp", "id", F.explode(kept).alias("key")).select("fp", "id", "key.k", "key.bits")


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Places of links that connect all that links of at most MAX_BITS bits connect: a breadth-first search whose every step compares one fingerprint with those not reached yet."""
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= MAX_BITS
            found = rest[near].tolist()
            rest = rest[~near]
            queue += found
            out += [(at, f) for f in found]
    return out


def _search(lists: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets to the links they hold."""
    for pdf in lists:
        a, b = [], []
        for members in pdf["members"]:
            fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
            ids = [m["id"] for m in members]
            for x, y in _spanning(fps):
                a.append(ids[x])
                b.append(ids[y])
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _gathered(rows: DataFrame) -> DataFrame:
    lists = rows.groupBy("k", "bits").agg(F.collect_list(F.struct("fp", "id")).alias("members")).select("members")
    return lists.mapInPandas(_search, "a long, b long")


def _hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between nodes (fp, id), enough of them to connect all that are within MAX_BITS bits."""
    keys = _keys(nodes, BLOCKS)
    sized = keys.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "id")).alias("lo"), F.max(F.struct("fp", "id")).alias("hi")).where("n > 1")
    sized = cut(sized)
    pairs = sized.where("n = 2").where(_hamming(F.col("lo.fp"), F.col("hi.fp")) <= MAX_BITS).select(F.col("lo.id").alias("a"), F.col("hi.id").alias("b"))
    many = cut(keys.join(sized.where("n > 2").select("k", "bits", "n"), ["k", "bits"]))
    small = _gathered(many.where(F.col("n") <= BUCKET))
    dense = many.where(F.col("n") > BUCKET).select("fp", "id").distinct()
    return pairs.unionByName(small).unionByName(_gathered(_keys(dense, FINE))).distinct()


def _rooted(marked: DataFrame) -> DataFrame:
    """fp, id (the least that has it), root (the least fingerprint that links reach): one row for each fingerprint of marked (id, fp)."""
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(links(nodes.select("fp", F.col("fp").alias("id")))).select(F.col("node").alias("fp"), "component")
    return nodes.join(found, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, component (the least id that links reach) for every row of docs."""
    marked = cut(with_fingerprints(docs, doc_id, text))
    rooted = _rooted(marked)
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("fp", "component")
    return marked.join(named, "fp", "left").select("id", "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: that of the least id, and of rows that repeat that id the one whose text has the least hash.

    Rows are known by id and hash of the text, so rows that share an id, or have none, are judged each by its own text.
    What goes is joined, not what stays: it is the shorter list, and while it is short, texts are not shuffled.
    """
    key, place, gone_id, gone_t = fresh(docs, "_key", "_place", "_id", "_t")
    marked = cut(with_fingerprints(docs.withColumn(key, F.xxhash64(text)), doc_id, text, key).withColumnRenamed(key, "t"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    rows = marked.join(_rooted(marked).select("fp", "root"), "fp").select("root", rank.alias("row"))
    many = sized(rows.groupBy("root").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "keep"))
    judged = cut(rows.join(many, "root").groupBy("row", "keep").agg(F.count(F.lit(1)).alias("n")).where("row <> keep OR n > 1"))
    gone = sized(judged.where("row <> keep").select(F.col("row.id").alias(gone_id), F.col("row.t").alias(gone_t)))
    out = docs.withColumn(key, F.xxhash64(text)).join(gone, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_t)), "left_anti")
    if judged.where("row = keep").isEmpty():
        return out.drop(key)
    first = Window.partitionBy(doc_id, key).orderBy(text, *[c for c in docs.columns if c not in (doc_id, text)])
    return out.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place, key)
