"""Stored blocks (lba, magic, header_bytes, original_bytes, stored_bytes, checksum, payload): sizes, compression, scrubbing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions.digests import xxh64

#: Fixed value: what every stored block starts with.
MAGIC = "BLCK"


def _whole(block_size: int) -> Column:
    """Bytes that a stored block takes on the volume: whole volume blocks for its header and payload."""
    return F.call_function("div", F.col("header_bytes") + F.col("stored_bytes") + (block_size - 1), F.lit(block_size)) * block_size


def physical(blocks: DataFrame, block_size: int) -> DataFrame:
    """blocks, compressed, uncompressed, original_bytes, stored_bytes, physical_bytes of all different blocks."""
    once = blocks.groupBy("lba").agg(*[F.max(c).alias(c) for c in ("header_bytes", "original_bytes", "stored_bytes")])
    smaller = F.col("stored_bytes") < F.col("original_bytes")
    none = F.lit(0).cast("long")
    return once.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(smaller).alias("compressed"), F.count_if(~smaller).alias("uncompressed"), *[F.coalesce(F.sum(F.col(c).cast("long")), none).alias(c) for c in ("original_bytes", "stored_bytes")], F.coalesce(F.sum(_whole(block_size).cast("long")), none).alias("physical_bytes"))


def compression(blocks: DataFrame, block_size: int) -> DataFrame:
    """original_bytes, stored_bytes, their ratio in hundredths and the share saved in hundredths of a percent."""
    p = physical(blocks, block_size)
    o, s = F.col("original_bytes"), F.col("stored_bytes")
    return p.select("original_bytes", "stored_bytes", F.when(s > 0, F.call_function("div", o * 100, s)).alias("ratio_hundredths"), F.when(o > 0, F.call_function("div", (o - s) * 10000, o)).alias("saved_basis_points"))


def savings_chain(logical: DataFrame, unique: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """step, bytes: what is left after each step: logical (a column `bytes` of files), deduplicated (of different sectors), compressed, physical."""
    p = physical(blocks, block_size)
    sums = [(n, df.agg(F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0).cast("long")).alias("bytes"))) for n, df in (("logical", logical), ("deduplicated", unique))]
    sums += [("compressed", p.select(F.col("stored_bytes").alias("bytes"))), ("physical", p.select(F.col("physical_bytes").alias("bytes")))]
    out = None
    for n, df in sums:
        row = df.select(F.lit(n).alias("step"), "bytes")
        out = row if out is None else out.unionByName(row)
    return out


def subchannel_ratio(cd_map: DataFrame) -> DataFrame:
    """cd_sectors, unique_subchannels and their ratio in hundredths. Repeats are dropped before they are counted, so a hot one is combined where it is read."""
    once = cd_map.where("subchannel_hash IS NOT NULL").groupBy("subchannel_hash").agg(F.count(F.lit(1)).alias("n"))
    row = once.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("cd_sectors"), F.count(F.lit(1)).alias("unique_subchannels"))
    return row.select("*", F.when(F.col("unique_subchannels") > 0, F.call_function("div", F.col("cd_sectors") * 100, F.col("unique_subchannels"))).alias("ratio_hundredths"))


def scrub(blocks: DataFrame, digest: Callable[[Column], Column] = xxh64) -> DataFrame:
    """lba, fault: blocks whose magic is wrong, or whose payload no longer gives their checksum."""
    fault = F.when(~F.col("magic").eqNullSafe(F.lit(MAGIC)), "magic").when(~F.col("checksum").eqNullSafe(digest(F.col("payload"))), "checksum")
    return blocks.select("lba", fault.alias("fault")).where("fault IS NOT NULL")


def worth_compressing(data: Column, level: int, saved_percent: int = 10) -> Column:
    """Whether a block is compressed at `level`: above level 3 only if a quick try at level 1 saves enough."""
    if level <= 3:
        return F.lit(True)

    @F.pandas_udf("boolean")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([v is not None and len(v) > 0 and 100 * len(zlib.compress(bytes(v), 1)) <= (100 - saved_percent) * len(v) for v in values])

    return probe(data.cast("binary"))
