"""Table schemas, and builders that lay the model over plain star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "meta": "inode_id bigint, key string, value string",
    "meta_index": "key string, value string, inode_id bigint",
    "meta_num": "key string, num bigint, inode_id bigint",
    "catalog": "inode_id bigint, parent_id bigint, is_dir boolean, name string",
    "inode": "inode_id bigint, uid bigint, gid bigint, mode bigint, created timestamp, modified timestamp, accessed timestamp, file_size bigint, extents array<struct<start_block:bigint,block_count:bigint,logical_blocks:bigint>>, file_type smallint, sector_count bigint, sector_map_size bigint, ref_count bigint",
    "overflow": "inode_id bigint, logical_offset bigint, start_block bigint, block_count bigint, logical_count bigint",
    "refcount": "lba bigint, ref_count bigint",
    "image": "inode_id bigint, sector_size int, data string",
    "sector_map": "inode_id bigint, sector bigint, sector_size int, hash string, lba bigint, offset bigint",
    "dedup_index": "sector_size int, hash string, lba bigint, offset bigint",
    "cd_sector_map": "inode_id bigint, sector bigint, sector_size int, hash string, generated_prefix boolean, prefix_hash string, generated_suffix boolean, suffix_hash string, subchannel_hash string, subheader binary, sector_mode smallint",
    "media_tag": "inode_id bigint, tag_type int, data binary",
    "sector_tag_ref": "inode_id bigint, sector bigint, tag_type int, tag_hash string",
    "sector_tag_data": "hash string, tag_type int, data binary",
    "region": "inode_id bigint, offset bigint, length bigint, partition_index int, seed array<bigint>",
    "plain_region": "inode_id bigint, start_sector bigint, end_sector bigint",
    "user_index": "key string, value_type smallint",
}
ROOT = 2
MAX_KEY, MAX_VALUE = 255, 1024
#: Sector sizes of image files by extension.
SECTOR_SIZES = {"dsk": 512, "img": 512, "ima": 512, "adf": 512, "xdf": 512, "usb": 512, "iso": 2048}
#: Identifiers of the tables that share one metadata table stand apart.
DOCUMENTS_FROM, ORDERS_FROM = 1_000_000_000, 2_000_000_000


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a time stamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ)) div 1000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_form(wide: DataFrame, inode: Column, values: dict[str, Column]) -> DataFrame:
    """inode_id, key, value: one row for each value that isn't null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return wide.select(inode.cast("long").alias("inode_id"), F.explode(pairs).alias("p")).select("inode_id", "p.key", "p.value").where("value IS NOT NULL")


def valid(meta: DataFrame) -> DataFrame:
    """The rows that the store accepts: a key of 1 to 255 bytes, a value of up to 1024 bytes."""
    return meta.where((F.octet_length("key").between(1, MAX_KEY)) & (F.octet_length("value") <= MAX_VALUE))


def part_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(read(spark, sf_dir, "part"), F.col("p_partkey"), {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size")})


def order_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(read(spark, sf_dir, "orders"), F.col("o_orderkey") + ORDERS_FROM, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "custkey": F.col("o_custkey")})


def document_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return long_form(docs, F.col("doc_id") + DOCUMENTS_FROM, {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars"), "text": F.col("text"), "Comments": F.col("text"), "quality": F.col("quality"), "toxic": F.col("toxic")})


def all_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(spark, sf_dir) for f in (part_meta, order_meta, document_meta)))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions hold nations, nations hold customers; the root is its own entry."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(F.lit(ROOT).cast("long").alias("inode_id"), F.lit(ROOT).cast("long").alias("parent_id"), F.lit(True).alias("is_dir"), F.lit("").alias("name"))
    regions = region.select((F.col("r_regionkey") + 10).cast("long").alias("inode_id"), F.lit(ROOT).cast("long").alias("parent_id"), F.lit(True).alias("is_dir"), F.col("r_name").alias("name"))
    nations = nation.select((F.col("n_nationkey") + 100).cast("long").alias("inode_id"), (F.col("n_regionkey") + 10).cast("long").alias("parent_id"), F.lit(True).alias("is_dir"), F.col("n_name").alias("name"))
    customers = customer.select((F.col("c_custkey") + 100_000).cast("long").alias("inode_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.lit(False).alias("is_dir"), F.col("c_name").alias("name"))
    return reduce(DataFrame.unionByName, (root, regions, nations, customers))


def customer_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of catalogue entries, and of some objects that no entry names."""
    c = read(spark, sf_dir, "customer")
    inode = F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 900_000_000).otherwise(F.col("c_custkey") + 100_000)
    return long_form(c, inode, {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")})


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("inode_id"), F.when(F.col("lang") == "en", 64).otherwise(128).alias("sector_size"), F.col("text").alias("data"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("inode_id"), F.lit(256).alias("sector_size"), F.col("html").alias("data"))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inode_id, start_block, block_count, logical_count: lines of an order as extents of a file."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("inode_id"), F.col("l_partkey").alias("start_block"), F.pmod(F.col("l_linenumber"), F.lit(4)).cast("long").alias("block_count"), F.pmod(F.col("l_linenumber") + F.col("l_orderkey"), F.lit(5)).cast("long").alias("logical_count"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals on each user's line of milliseconds, closed by the next one's start at the latest."""
    return regions_of(read(spark, sf_dir, "events"))


def regions_of(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    at = events.where("event_id % 3 = 0").groupBy("user_id", millis("ts").alias("offset")).agg(F.min("event_id").alias("event_id"))
    step = F.lead("offset").over(Window.partitionBy("user_id").orderBy("offset")) - F.col("offset")
    return at.select(F.col("user_id").alias("inode_id"), "offset", F.least(F.coalesce(step, F.lit(3_600_000)), F.lit(3_600_000)).alias("length"), (F.col("event_id") % 4).cast("int").alias("partition_index"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.where("event_id % 3 <> 0").select("event_id", F.col("user_id").alias("inode_id"), millis("ts").alias("at"))
