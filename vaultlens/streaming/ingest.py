"""Incremental ingestion with Structured Streaming: every micro-batch of images adds what is new, and nothing twice.

ingest() keeps "which sectors are known" in the stored dictionary itself, read with an anti-join: right where batches are
large beside the dictionary's hashes. A batch writes to a folder of its own number and overwrites it when it is repeated,
which makes the sink exact once; readers see the union of the folders.

ingest_stateful() keeps the known hashes in a state store on disk, dealt out by hash, so that a batch costs what it
holds and not what was stored before: right for many small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultlens.operators import sectors

DICTIONARY = "sector_size int, hash string, data string, batch long"
MAP = "inode_id long, sector long, sector_size int, hash string, batch long"


def _known(spark: SparkSession, base: str, before: int) -> DataFrame:
    """The dictionary as earlier batches left it."""
    return spark.read.schema(DICTIONARY).option("recursiveFileLookup", "true").parquet(f"{base}/dictionary").where(F.col("batch") < before)


def _prepare(spark: SparkSession, base: str) -> None:
    for name, schema in (("dictionary", DICTIONARY), ("map", MAP)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}/none")


def ingest(images: DataFrame, base: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts ingesting a stream of images (inode_id, sector_size, data) to base/dictionary and base/map."""
    spark = images.sparkSession
    _prepare(spark, base)

    def add(batch: DataFrame, number: int) -> None:
        cut = sectors.sliced(batch)
        new = sectors.new_sectors(cut, _known(batch.sparkSession, base, number)).select("sector_size", "hash", "data")
        new.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/dictionary/{number:09d}")
        sectors.sector_map(cut).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/map/{number:09d}")

    writer = images.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stateful(images: DataFrame, base: str, checkpoint: str, available_now: bool = True) -> list[StreamingQuery]:
    """Starts ingesting a stream of images to base/dictionary and base/map, each by a query of its own; both write a file once."""
    spark = images.sparkSession
    _prepare(spark, base)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cut, none = sectors.sliced(images), F.lit(None).cast("long").alias("batch")
    parts = {"dictionary": cut.dropDuplicates(["sector_size", "hash"]).select("sector_size", "hash", "data", none), "map": sectors.sector_map(cut).select("*", none)}
    out = []
    for name, part in parts.items():
        writer = part.writeStream.format("parquet").outputMode("append").option("path", f"{base}/{name}/stream").option("checkpointLocation", f"{checkpoint}/{name}")
        out.append((writer.trigger(availableNow=True) if available_now else writer).start())
    return out


def stored(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary and the sector map of all batches."""
    d = spark.read.schema(DICTIONARY).option("recursiveFileLookup", "true").parquet(f"{base}/dictionary").drop("batch")
    m = spark.read.schema(MAP).option("recursiveFileLookup", "true").parquet(f"{base}/map").drop("batch")
    return d, m


def first_seen(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """A stream without repeats of its keys within the watermark: bounded state for unbounded streams."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
