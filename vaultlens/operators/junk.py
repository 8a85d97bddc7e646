"""Regions that a generator can make again: left out of the store, recorded as intervals, regenerated on reading.

Sectors outside every data region are compared with what the generator gives for their place; where they agree, the
sector is stored as zeros (one shared sector) and its place becomes part of an interval with the generator's seed. An
object has one seed, or one for each block of block_size bytes, which recovered_seeds() finds from the sectors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.functions import lagged
from vaultlens.operators import intervals

Generator = Callable[[Any, int, int], bytes]  # seed (a number or bytes), first byte, size -> bytes


def _made(rows: DataFrame, generator: Generator) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [generator(s, a, n) for s, a, n in zip(pdf["seed"], pdf["at"], pdf["sector_size"], strict=True)]
            yield pdf[["inode_id", "sector"]].assign(made=made)

    return rows.select("inode_id", "sector", "at", "sector_size", "seed").mapInPandas(run, "inode_id long, sector long, made binary")


def _block(block_size: int) -> Column:
    return F.floor(F.col("at") / block_size).alias("block")


def _seed_of_block(at: list[int], data: list[bytes], block_size: int) -> bytes | None:
    """Of the seeds that some run of a block's sectors gives, the one whose stream explains most bytes (ties: the least)."""
    explained: dict[bytes, int] = {}
    done: set[int] = set()
    for k in range(len(data)):
        if k in done:
            continue
        run, j = data[k], k + 1
        while len(run) < lagged.ENOUGH and j < len(data) and at[j] == at[k] + len(run):
            run, j = run + data[j], j + 1
        seed = lagged.seed_of(run, at[k])
        if seed is not None and seed not in explained:
            whole = lagged.stream(seed, 0, block_size)
            same = {i for i, x in enumerate(data) if whole[at[i] : at[i] + len(x)] == x}
            done |= same
            explained[seed] = sum(len(data[i]) for i in same)
    return min(explained, key=lambda seed: (-explained[seed], seed), default=None)


def recovered_seeds(sectors: DataFrame, data_regions: DataFrame, block_size: int, width: int) -> DataFrame:
    """inode_id, block, seed: the seed of the lagged Fibonacci generator for each block of block_size bytes in which some run of sectors is its stream.

    sectors: inode_id, sector, sector_size, data; block_size is a multiple of sector_size, and the stream starts anew in each block. Sectors of
    data regions are left out. Null and empty data take part in no run; of rows that repeat a sector the least data counts. A block bounds
    what one task holds at a time, whatever the size of an object.
    """

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "data"]).drop_duplicates("at")
        seed = _seed_of_block((pdf["at"] % block_size).tolist(), [bytes(x) for x in pdf["data"]], block_size)
        rows = [] if seed is None else [(int(pdf["inode_id"].iloc[0]), int(pdf["block"].iloc[0]), seed)]
        return pd.DataFrame(rows, columns=["inode_id", "block", "seed"])

    placed = sectors.where(F.octet_length("data") > 0).withColumn("at", F.col("sector") * F.col("sector_size"))
    free = intervals.outside(placed, data_regions, width).select("inode_id", "at", _block(block_size), F.col("data").cast("binary").alias("data"))
    return free.groupBy("inode_id", "block").applyInPandas(found, "inode_id long, block long, seed binary")


def elided(sectors: DataFrame, data_regions: DataFrame, seeds: DataFrame, generator: Generator, width: int, block_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """sectors (inode_id, sector, sector_size, data) with what can be regenerated as zeros, and its intervals (inode_id, offset, length, seed).

    seeds: inode_id, seed, and with a block_size also block; then an interval ends where its block does.
    """
    placed = sectors.withColumn("at", F.col("sector") * F.col("sector_size"))
    on = ["inode_id"] if block_size is None else ["inode_id", "block"]
    free = intervals.outside(placed, data_regions, width)
    free = (free if block_size is None else free.select("*", _block(block_size))).join(seeds.select(*on, "seed"), on)
    same = free.join(_made(free, generator), ["inode_id", "sector"]).where(F.col("data") == F.col("made")).select("inode_id", "sector", "sector_size", "seed", "at")
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("sector_size")))
    out = placed.join(same.select("inode_id", "sector", F.lit(True).alias("gone")), ["inode_id", "sector"], "left")
    kept = out.select("inode_id", "sector", "sector_size", F.when(F.col("gone"), zeros).otherwise(F.col("data")).alias("data"))
    runs = same.select("inode_id", F.col("at").alias("offset"), F.col("sector_size").cast("long").alias("length"), "seed")
    return kept, intervals.merge_adjacent(runs, ["seed"])


def regenerated(sectors: DataFrame, junk: DataFrame, generator: Generator, width: int) -> DataFrame:
    """sectors as they were: those in an interval come from the generator."""
    placed = sectors.withColumn("at", F.col("sector") * F.col("sector_size"))
    inside = intervals.locate(placed.drop("data"), junk, width)
    made = _made(inside, generator)
    return sectors.join(made, ["inode_id", "sector"], "left").select("inode_id", "sector", "sector_size", F.coalesce("made", "data").alias("data"))


def delete(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """runs without those of some objects (inode_id), or those that start at some places of theirs (inode_id, offset)."""
    on = [c for c in ("inode_id", "offset") if c in gone.columns]
    return runs.join(gone.select(*on).distinct(), on, "left_anti")
