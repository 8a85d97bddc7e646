"""Cutting the lineage of iterative queries through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary one serves a single machine; a cluster must name one that all its machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='vaultlens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, stored reliably in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the place (from 0) of each row in the order of `by`, which should be unique.

    Rows are sorted in range partitions and numbered there; positions come from the partitions' counts. Which row is in
    which partition is known for good only once it is written down, so the numbered rows are stored before they are counted.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_row": row}))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One row a partition, so this window is small however many rows there are.
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many parts by its keys as spark.sql.shuffle.partitions says. Adaptive execution, left to choose, would join parts until there is one a core, however much that one holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame, key: str, each: int) -> DataFrame:
    """df in parts of about `each` rows, which are counted first: for rows from which far more is made than their files hold, so that a file's size says nothing about a task's work."""
    return df.repartition(max(1, -(-df.count() // each)), key)
