"""Object attributes (one row an object) and the volume that holds the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.operators.metadata import latest
from vaultlens.operators.tags import TAG_TYPES
from vaultlens.sources.model import ROOT, SCHEMAS


def get(inodes: DataFrame, inode_id: int) -> DataFrame:
    return inodes.where(F.col("inode_id") == inode_id)


def put(inodes: DataFrame, changes: DataFrame) -> DataFrame:
    """inodes after rows with the same id replaced theirs; of several changes of one object the latest `version` counts."""
    new = latest(changes, ["inode_id"], "version").drop("version")
    return inodes.join(new.select("inode_id"), "inode_id", "left_anti").unionByName(new.select(inodes.columns))


def delete(inodes: DataFrame, gone: DataFrame) -> DataFrame:
    return inodes.join(gone.select("inode_id"), "inode_id", "left_anti")


def updated(inodes: DataFrame, inode_id: int, **values) -> DataFrame:
    """inodes with columns of one object set: mode, owner, times or size."""
    this = F.col("inode_id") == inode_id
    kinds = dict(inodes.dtypes)
    return inodes.withColumns({k: F.when(this, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in values.items()})


def truncated(inodes: DataFrame, inode_id: int, size: int) -> DataFrame:
    return updated(inodes, inode_id, file_size=size)


def attribute_names(meta: DataFrame, tags: DataFrame, inode_id: int, meta_prefix: str = "user.metadata.", tag_prefix: str = "user.mediatag.") -> DataFrame:
    """name: the extended attributes of an object, one for each metadata key and each media tag."""
    keys = meta.where(F.col("inode_id") == inode_id).select(F.concat(F.lit(meta_prefix), "key").alias("name"))
    types = tags.where(F.col("inode_id") == inode_id).select(F.concat(F.lit(tag_prefix), F.col("tag_type").cast("string")).alias("name"))
    return keys.unionByName(types)


def attribute(meta: DataFrame, tags: DataFrame, inode_id: int, name: str, meta_prefix: str = "user.metadata.", tag_prefix: str = "user.mediatag.") -> DataFrame:
    """value: one extended attribute as bytes; no row if there is none."""
    if name.startswith(meta_prefix):
        return meta.where((F.col("inode_id") == inode_id) & (F.col("key") == name[len(meta_prefix) :])).select(F.encode("value", "UTF-8").alias("value"))
    number = name[len(tag_prefix) :]
    kept = name.startswith(tag_prefix) and number.isdigit()
    return tags.where((F.col("inode_id") == inode_id) & (F.col("tag_type") == int(number)) if kept else F.lit(False)).select(F.col("data").cast("binary").alias("value"))


def _target(name: str, meta_prefix: str, tag_prefix: str) -> tuple[str, str | int]:
    number = name[len(tag_prefix) :]
    if name.startswith(meta_prefix) and len(name) > len(meta_prefix):
        return "meta", name[len(meta_prefix) :]
    if name.startswith(tag_prefix) and number.isdigit() and int(number) in TAG_TYPES:
        return "tag", int(number)
    raise KeyError(name)


def with_attribute(meta: DataFrame, tags: DataFrame, inode_id: int, name: str, value: bytes, meta_prefix: str = "user.metadata.", tag_prefix: str = "user.mediatag.") -> tuple[DataFrame, DataFrame]:
    """meta and tags after an extended attribute is set: a metadata value (text) or a media tag (bytes)."""
    kind, key = _target(name, meta_prefix, tag_prefix)
    meta, tags = without_attribute(meta, tags, inode_id, name, meta_prefix, tag_prefix)
    spark = meta.sparkSession
    if kind == "meta":
        return meta.unionByName(spark.createDataFrame([(inode_id, key, value.decode("utf-8"))], SCHEMAS["meta"])), tags
    new = spark.createDataFrame([(inode_id, key, bytearray(value))], SCHEMAS["media_tag"])
    return meta, tags.unionByName(new.withColumn("data", F.col("data").cast(tags.schema["data"].dataType)))


def without_attribute(meta: DataFrame, tags: DataFrame, inode_id: int, name: str, meta_prefix: str = "user.metadata.", tag_prefix: str = "user.mediatag.") -> tuple[DataFrame, DataFrame]:
    """meta and tags after an extended attribute is removed."""
    kind, key = _target(name, meta_prefix, tag_prefix)
    this = F.col("inode_id") == inode_id
    return (meta.where(~(this & (F.col("key") == key))), tags) if kind == "meta" else (meta, tags.where(~(this & (F.col("tag_type") == key))))


def create_volume(spark: SparkSession, path: str) -> None:
    """Empty tables of every kind, and the root directory."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("error").parquet(f"{path}/{name}")
    spark.createDataFrame([(ROOT, ROOT, True, "")], SCHEMAS["catalog"]).write.mode("append").parquet(f"{path}/catalog")


def check_volume(spark: SparkSession, path: str) -> DataFrame:
    """table, fault: tables whose columns aren't the model's."""
    rows = []
    for name, schema in SCHEMAS.items():
        try:
            found = spark.read.parquet(f"{path}/{name}").dtypes
        except Exception:  # noqa: BLE001  Spark has several errors for a folder that can't be read
            rows.append((name, "missing"))
            continue
        if found != spark.createDataFrame([], schema).dtypes:
            rows.append((name, "other columns"))
    return spark.createDataFrame(rows, "table string, fault string")


def by_kind(inodes: DataFrame) -> DataFrame:
    size: Column = F.sum("file_size")
    return inodes.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"), size.alias("size"))
