"""What several operators share: words, bindings inside lambdas, lineage cuts, table reading, unique column names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.functions.lineage import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: Fixed value: the white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package also when only the driver's sys.path knows it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def give_back() -> None:
    """Returns a worker's free memory to the system: workers stay for a minute after a task, and so would what its texts took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim is not None:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body's lambdas refer to it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Folders that this driver has made in the shared folder; what was read from them may still be lazy.
_MADE: list[str] = []


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder, remembered for release()."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many folders there are: a mark for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the folders made since a mark. Call it when every result that is computed from them has been written."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _MADE[since:] if p not in keep]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
        _MADE.remove(path)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: like cut(), for tables that are large or read column by column."""
    spark, path = df.sparkSession, folder(df.sparkSession, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which sized() broadcasts; its rows hold a few numbers each, some 64 bytes in a worker's memory.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, limit: int | None = None, weight: Column | None = None) -> DataFrame:
    """df stored, counted, and marked for broadcast if it has at most `limit` rows; beyond that joins shuffle it.

    weight counts what a row of no fixed size holds, such as the members of an array, in units of 64 bytes.
    """
    df = cut(df)
    n = df.count() if weight is None else df.agg(F.coalesce(F.sum(F.ceil(weight) + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= (BROADCAST_ROWS if limit is None else limit) else df


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Maximal runs of other characters than white space; none for null and blank texts."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def single_spaced(text: Column) -> Column:
    """The words joined by one space. Texts that have them so already, as most lines do, are not searched by a pattern."""
    odd = F.lit(False)
    for run in ("  ", *SPACE_CHARS[1:]):
        odd = odd | F.contains(text, F.lit(run))
    t = trimmed(text)
    return F.when(odd, F.regexp_replace(t, SPACE_RUN, " ")).otherwise(t)


def n_words(spaced: Column) -> Column:
    """Words of a single_spaced() text."""
    return F.when(spaced == "", 0).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
