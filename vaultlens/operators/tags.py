"""Binary side tables: media tags by (object, type) and sector tags as a dictionary with references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: tag types run from 0 to 86, without 68.
TAG_TYPES = [t for t in range(87) if t != 68]


def valid(tags: DataFrame) -> DataFrame:
    return tags.where(F.col("tag_type").between(0, 86) & (F.col("tag_type") != 68))


def get(tags: DataFrame, inode_id: int, tag_type: int) -> DataFrame:
    return tags.where((F.col("inode_id") == inode_id) & (F.col("tag_type") == tag_type)).select("data")


def types_of(tags: DataFrame) -> DataFrame:
    """inode_id and its sorted tag types; at most 86 of them an object."""
    return tags.groupBy("inode_id").agg(F.sort_array(F.collect_set("tag_type")).alias("tag_types"))


def put(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags after new ones (inode_id, tag_type, data) replaced those of the same object and type."""
    return tags.join(new.select("inode_id", "tag_type"), ["inode_id", "tag_type"], "left_anti").unionByName(new)


def delete(tags: DataFrame, gone: DataFrame, columns: tuple[str, ...] = ("inode_id", "tag_type")) -> DataFrame:
    return tags.join(gone.select(*columns), list(columns), "left_anti")


def tag_hash(tag_type, data):
    """A digest of the type and the contents together."""
    return F.md5(F.concat(F.unhex(F.lpad(F.hex(tag_type), 4, "0")), data.cast("binary")))


def normalised(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (inode_id, sector, tag_type, data) as references and a dictionary of different contents."""
    hashed = rows.withColumn("tag_hash", tag_hash(F.col("tag_type"), F.col("data")))
    refs = hashed.select("inode_id", "sector", "tag_type", "tag_hash")
    data = hashed.groupBy(F.col("tag_hash").alias("hash"), "tag_type").agg(F.first("data").alias("data"))
    return refs, data


def resolved(refs: DataFrame, data: DataFrame) -> DataFrame:
    return refs.join(data.select(F.col("hash").alias("tag_hash"), "data"), "tag_hash").select("inode_id", "sector", "tag_type", "data")
