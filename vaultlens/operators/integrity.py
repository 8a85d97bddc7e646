"""Consistency checks, each one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.functions.lineage import cut
from vaultlens.operators.intervals import previous


def extent_faults(extents: DataFrame, blocks: int) -> DataFrame:
    """Extents that are wrong, and why; an unused slot (all zero) is fine."""
    s, n, logical = F.col("start_block"), F.col("block_count"), F.col("logical_count")
    unused = (s == 0) & (n == 0) & (logical == 0)
    why = F.when(n == 0, "empty").when(s == 0, "no start").when(s + n > blocks, "out of bounds").when(logical < n, "logical below physical")
    return extents.where(~unused).withColumn("fault", why).where("fault IS NOT NULL")


def references(extents: DataFrame) -> DataFrame:
    """lba, refs: how often extents name each block. Extents are split into blocks by Spark, counted before the shuffle."""
    blocks = extents.where("block_count > 0").select(F.explode(F.sequence(F.col("start_block"), F.col("start_block") + F.col("block_count") - 1)).alias("lba"))
    return blocks.groupBy("lba").agg(F.count(F.lit(1)).alias("refs"))


def refcounts(extents: DataFrame) -> DataFrame:
    """The sparse table: blocks with more than one reference."""
    return references(extents).where("refs > 1").withColumnRenamed("refs", "ref_count")


def refcount_of(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    return blocks.join(stored, "lba", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(1).cast("long")))


def refcount_differences(extents: DataFrame, stored: DataFrame) -> DataFrame:
    """lba, expected, stored where the stored count differs or is stale."""
    want = refcounts(extents).withColumnRenamed("ref_count", "expected")
    both = want.join(stored.withColumnRenamed("ref_count", "stored"), "lba", "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("stored"))).select("lba", F.coalesce("expected", F.lit(1).cast("long")).alias("expected"), F.coalesce("stored", F.lit(1).cast("long")).alias("stored"))


def size_mismatches(inodes: DataFrame, extents: DataFrame, block_size: int) -> DataFrame:
    """inode_id, file_size, held: regular files whose extents hold fewer blocks than their size needs."""
    held = extents.groupBy("inode_id").agg((F.sum("logical_count") * block_size).alias("held"))
    both = inodes.select("inode_id", "file_size").join(held, "inode_id", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
    return both.where(F.col("file_size") > F.col("held"))


def bitmap_differences(owned: DataFrame, used: DataFrame) -> DataFrame:
    """lba, fault: blocks marked used that nobody owns (leaked), owned ones that aren't marked (missing)."""
    sides = owned.select("lba", F.lit(1).alias("s")).unionByName(used.select("lba", F.lit(2).alias("s")))
    seen = sides.groupBy("lba").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return seen.where("lo = hi").select("lba", F.when(F.col("lo") == 1, "missing").otherwise("leaked").alias("fault"))


def owners(sources: dict[str, DataFrame]) -> DataFrame:
    """lba, owner from every class of owner."""
    out = None
    for name, df in sources.items():
        part = df.select("lba", F.lit(name).alias("owner"))
        out = part if out is None else out.unionByName(part)
    return out


def block_classes(owned: DataFrame) -> DataFrame:
    return owned.groupBy("owner").agg(F.countDistinct("lba").alias("blocks"))


def shared_blocks(owned: DataFrame) -> DataFrame:
    """Blocks that several owners claim."""
    return owned.distinct().groupBy("lba").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def space(used: DataFrame, total: int) -> DataFrame:
    n = F.count(F.lit(1))
    return used.select("lba").distinct().agg(n.alias("used"), (F.lit(total) - n).alias("free"))


def location_differences(smap: DataFrame, index: DataFrame) -> DataFrame:
    """Sector map rows whose cached location isn't the index's."""
    at = index.select("sector_size", "hash", F.col("lba").alias("true_lba"), F.col("offset").alias("true_offset"))
    both = smap.join(at, ["sector_size", "hash"], "left")
    return both.where(~(F.col("lba").eqNullSafe(F.col("true_lba")) & F.col("offset").eqNullSafe(F.col("true_offset")))).select("inode_id", "sector", "lba", "true_lba")


def overflow_sums(overflow: DataFrame) -> DataFrame:
    return overflow.groupBy("inode_id").agg(F.sum("logical_count").alias("logical_blocks"), F.count(F.lit(1)).alias("extents"))


def next_inode(inodes: DataFrame) -> DataFrame:
    return inodes.agg((F.coalesce(F.max("inode_id"), F.lit(2)) + 1).alias("next_inode_id"))


def order_faults(rows: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """Rows whose key isn't above the one before."""
    return previous(rows, by, at, key, "before").where(F.col("before") >= F.col(key))


def superblock_faults(sb: DataFrame, blocks: int) -> DataFrame:
    """Fields of the singleton (name, lba) that are out of range or share a block."""
    n = F.count(F.lit(1)).over(Window.partitionBy("lba"))
    return sb.withColumn("fault", F.when((F.col("lba") < 1) | (F.col("lba") >= blocks), "out of range").when(n > 1, "shared")).where("fault IS NOT NULL")


def volume_faults(volumes: DataFrame, now: int) -> DataFrame:
    """volume, fault of volume records (volume, block_size, dedup_block_size, total_bytes, next_inode_id, bitmap_lba, bitmap_blocks, label, created): one row for each rule that a record breaks."""
    size, dedup, total = F.col("block_size"), F.col("dedup_block_size"), F.col("total_bytes")
    blocks = F.call_function("div", total, F.greatest(size, F.lit(1)))

    def not_power(c: Column) -> Column:
        return (c <= 0) | (c.bitwiseAND(c - 1) != 0)

    rules = {
        "block size is no power of two": not_power(size),
        "block size is below 4096": ~not_power(size) & (size < 4096),
        "dedup block size is no power of two": not_power(dedup),
        "dedup block size is below the block size": ~not_power(dedup) & (dedup < size),
        "size is no multiple of the block size": F.pmod(total, F.greatest(size, F.lit(1))) != 0,
        "next inode is below 3": F.col("next_inode_id") < 3,
        "bitmap is missing": F.col("bitmap_lba") == 0,
        "bitmap is out of range": (F.col("bitmap_lba") > 0) & (F.col("bitmap_lba") + F.col("bitmap_blocks") > blocks),
        "label has no end": ~F.contains("label", F.lit("\0")),
        "time is not set": F.col("created") == 0,
        "time is in the future": F.col("created") > now,
    }
    faults = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return volumes.select("volume", F.explode(faults).alias("fault"))


def relocation(moves: DataFrame) -> DataFrame:
    """old, new with chains shortened: A to B and B to C make A to C. Doubling: each round halves the chains."""
    now = moves.select("old", "new")
    for _ in range(64):
        on = now.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        step = cut(now.join(on, F.col("new") == F.col("_o"), "left").select("old", F.coalesce("_n", "new").alias("new"), F.col("_n").isNotNull().alias("moved")))
        done = step.where("moved").isEmpty()
        now = step.select("old", "new")
        if done:
            return now
    raise ValueError("moves form a cycle")
