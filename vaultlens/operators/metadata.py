"""Operators over the long metadata table (inode_id, key, value; one value for each object and key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.functions.lineage import numbered
from vaultlens.functions.scalar import is_whole_int, listed, strtoll

#: Columns of a wide table, results of a page.
MAX_COLUMNS, PAGE = 32, 8


def point(meta: DataFrame, inode_id: int, key: str) -> DataFrame:
    return meta.where((F.col("inode_id") == inode_id) & (F.col("key") == key))


def keys_of(meta: DataFrame, inode_id: int) -> DataFrame:
    return meta.where(F.col("inode_id") == inode_id).select("key").orderBy("key")


def numeric_index(meta: DataFrame) -> DataFrame:
    """key, num, inode_id of the values that are one whole integer."""
    return meta.where(is_whole_int(F.col("value"))).select("key", strtoll(F.col("value")).alias("num"), "inode_id")


def numeric_range(index: DataFrame, key: str, low: int, high: int) -> DataFrame:
    return index.where((F.col("key") == key) & F.col("num").between(low, high)).select("inode_id").distinct()


def _values(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("inode_id", F.explode(listed(F.col("key"), F.col("value"))).alias("value"))


def distinct(meta: DataFrame, key: str) -> DataFrame:
    return _values(meta, key).select("value").distinct()


def group_by(meta: DataFrame, key: str) -> DataFrame:
    """value, n: objects that have the value. An object's repeated lines are dropped in its own row, so counting needs no second shuffle."""
    rows = meta.where(F.col("key") == key).select(F.explode(F.array_distinct(listed(F.col("key"), F.col("value")))).alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def stats(meta: DataFrame, key: str) -> DataFrame:
    """n, min, max, sum over the leading integers of all values, and avg to two decimals (null without values)."""
    n = strtoll(F.col("value"))
    wide = F.sum(n.cast("decimal(38,0)"))
    row = _values(meta, key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(n), F.lit(0)).alias("min"), F.coalesce(F.max(n), F.lit(0)).alias("max"), F.coalesce(wide, F.lit(0)).cast("decimal(38,0)").alias("sum"))
    return row.select("n", "min", "max", F.col("sum").cast("string").alias("sum"), F.when(F.col("n") > 0, F.round(F.col("sum") * 100 / F.col("n"), 0).cast("decimal(38,0)").cast("string")).alias("avg_hundredths"))


def with_metadata(ids: DataFrame, meta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ids with a map of their metadata, empty where there is none (256 keys an object are stored at most)."""
    rows = meta if keys is None else meta.where(F.col("key").isin(keys))
    maps = rows.groupBy("inode_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    empty = F.create_map().cast("map<string,string>")
    return ids.join(maps, "inode_id", "left").withColumn("metadata", F.coalesce("metadata", empty))


def first_seen_keys(ids: DataFrame, meta: DataFrame, most: int = MAX_COLUMNS) -> list[str]:
    """The keys that become columns: the first `most` that are met going through the objects in inode order, and through an object's keys in theirs."""
    firsts = meta.join(ids.select("inode_id"), "inode_id", "left_semi").groupBy("key").agg(F.min("inode_id").alias("at"))
    return [r["key"] for r in firsts.orderBy("at", "key").limit(most).collect()]


def wide(ids: DataFrame, meta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One column for each key, empty where it is missing; without names, those of first_seen_keys()."""
    keys = first_seen_keys(ids, meta) if keys is None else keys
    rows = ids.join(meta.where(F.col("key").isin(keys)), "inode_id", "left")
    table = rows.groupBy("inode_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    return table.select("inode_id", *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys])


def sort_value(metadata: Column, key: str) -> Column:
    """The value that results are ordered by: N:key as a number with 0 for a missing key, else a string with "" for it."""
    if key[:2].upper() == "N:":
        return strtoll(F.coalesce(metadata[key[2:]], F.lit("")))
    return F.coalesce(metadata[key], F.lit(""))


def limited(ids: DataFrame, n: int) -> DataFrame:
    """The first n in inode order (0: all): the limit comes before any other ordering."""
    return ids.orderBy("inode_id").limit(n) if n else ids


def positions(ids: DataFrame) -> DataFrame:
    """inode_id and its place among the results, which stand in inode order; numbered by ranges, not in one task."""
    return numbered(ids.select("inode_id"), ["inode_id"], "position")


def paged(ids: DataFrame, after: int | None = None, size: int = PAGE) -> DataFrame:
    """The next `size` results in inode order beyond a cursor, the last inode_id that was seen."""
    rest = ids if after is None else ids.where(F.col("inode_id") > after)
    return rest.orderBy("inode_id").limit(size)


def page_at(ids: DataFrame, offset: int, size: int = PAGE) -> DataFrame:
    """`size` results from a place on."""
    return ids.orderBy("inode_id").offset(offset).limit(size)


def ordered(rows: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    """Rows (inode_id, path, metadata) ordered by path or by a metadata key."""
    value = F.col("path") if key == "path" else sort_value(F.col("metadata"), key)
    return rows.orderBy(value.desc() if reverse else value, F.col("inode_id"))


def top(rows: DataFrame, key: str, n: int, reverse: bool = False) -> DataFrame:
    """What an ORDER BY before the LIMIT would give."""
    return ordered(rows, key, reverse).limit(n)


def upsert(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """meta after the changes (with a column `version`): the latest value of each (object, key)."""
    every = meta.withColumn("version", F.lit(-1).cast("long")).unionByName(changes)
    latest = every.groupBy("inode_id", "key").agg(F.max(F.struct("version", "value")).alias("v"))
    return latest.select("inode_id", "key", "v.value")


def delete(meta: DataFrame, gone: DataFrame) -> DataFrame:
    return meta.join(gone, ["inode_id", "key"], "left_anti")


def delete_all(meta: DataFrame, gone: DataFrame) -> DataFrame:
    return meta.join(gone.select("inode_id"), "inode_id", "left_anti")


def index_differences(meta: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that only one of the two tables has, and which lacks them."""
    sides = meta.select("inode_id", "key", "value", F.lit(1).alias("s")).unionByName(index.select("inode_id", "key", "value", F.lit(2).alias("s")))
    seen = sides.groupBy("inode_id", "key", "value").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return seen.where("lo = hi").select("inode_id", "key", "value", F.when(F.col("lo") == 1, "index").otherwise("primary").alias("missing_from"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an order column."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class UserIndexes:
    """Registry of secondary indexes. A numeric one is a clustered copy of a key's whole integers; answers never change."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, str]] = []

    def create(self, key: str, kind: str = "numeric") -> None:
        if kind not in ("numeric", "string"):
            raise ValueError(f"unknown index type {kind}")
        if any(k == key for k, _ in self.entries):
            raise ValueError(f"an index on {key} exists")
        self.entries.append((key, kind))

    def drop(self, key: str) -> None:
        if not any(k == key for k, _ in self.entries):
            raise KeyError(key)
        self.entries = [e for e in self.entries if e[0] != key]

    def show(self, spark) -> DataFrame:
        rows = [(k, 1 if kind == "numeric" else 0) for k, kind in self.entries]
        return spark.createDataFrame(rows, "key string, value_type int")

    def materialise(self, meta: DataFrame, path: str) -> None:
        """Writes the numeric indexes clustered by key and number, so that ranges prune row groups."""
        keys = [k for k, kind in self.entries if kind == "numeric"]
        numeric_index(meta.where(F.col("key").isin(keys))).repartitionByRange("key", "num").sortWithinPartitions("key", "num").write.mode("overwrite").partitionBy("key").parquet(path)
