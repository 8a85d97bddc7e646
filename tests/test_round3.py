"""Larger tables than the smallest: queries against their SQL, and the memory and broadcasts of their plans."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vaultlens.functions import digests
from vaultlens.operators import intervals, sectors
from vaultlens.plans import store

Q, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def same(spark, folder, name):
    """Whether a query gives its SQL's rows over the tables of a folder, each a file or a folder of files."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in folder.iterdir():
        at = f"{table}/*.parquet" if table.is_dir() else str(table)
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{at}'")
    got = Q[name](spark, str(folder))
    want = con.sql(SQL[name])
    assert set(got.columns) == set(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect())))
    assert rows == sorted(map(repr, want.fetchall())) and rows


def test_addresses_from_100_minutes_on(spark, tmp_path):
    ids = F.col("id") * 44_987
    spark.range(150).select(ids.alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same(spark, tmp_path, "cd_prefix")


def test_plain_regions_of_every_image(spark, tmp_path):
    ids = F.col("id") * 37
    spark.range(3000).select(ids.alias("event_id"), (F.col("id") % 1000).alias("user_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same(spark, tmp_path, "plain_sectors")


def test_any_number_of_plain_regions(spark):
    """inside_any's bound picks a broadcast or a shuffle; every region counts either way."""
    points = spark.range(300).select((F.col("id") % 7).alias("inode_id"), F.col("id").alias("at"))
    spans = spark.range(60).select((F.col("id") % 5).alias("inode_id"), (F.col("id") * 5).alias("start_sector"), (F.col("id") * 5 + F.col("id") % 3).alias("end_sector"))
    want = {(k % 7, k): any(s % 5 == k % 7 and s * 5 <= k <= s * 5 + s % 3 for s in range(60)) for k in range(300)}
    for most in (0, 59, 10_000):
        got = intervals.inside_any(points, spans, most).collect()
        assert {(r.inode_id, r.at): r.plain for r in got} == want and len(got) == 300


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_folder_of_files(spark, sf, tmp_path, files):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, tmp_path, "stream_ingest")


@pytest.mark.parametrize("name", ["islands", "frag_pct", "merge_adjacent"])
def test_neighbours_are_sorted_in_a_fixed_number_of_parts(spark, sf, name):
    """No grouping before the one sort, and parts that adaptive execution doesn't join."""
    plan = Q[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "HashAggregate(keys=[inode_id" not in plan.split("REPARTITION_BY_NUM")[-1]


def test_runs_with_repeats(spark):
    rows = [(i, (k * 7) % 40, (k * 7) % 40 // 6) for i in range(3) for k in range(25)]
    df = spark.createDataFrame(rows * 3, "inode_id long, offset long, seed long")
    want = set()
    for i in range(3):
        run = None
        for _, o, s in sorted({r for r in rows if r[0] == i}):
            if run and run[2] == o and run[3] == s:
                run = (i, run[1], o + 1, s)
            else:
                want |= {run} if run else set()
                run = (i, o, o + 1, s)
        want.add(run)
    for width in (1, 2, 5, 1000):
        got = intervals.merge_adjacent(df.withColumn("length", F.lit(1).cast("long")), ["seed"], width, once=True).collect()
        assert sorted((r.inode_id, r.offset, r.offset + r.length, r.seed) for r in got) == sorted(want)


def test_sectors_put_together_are_not_broadcast(spark, sf):
    plan = Q["cd_rebuild"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [inode_id" not in plan and "SortMergeJoin [inode_id" in plan


def test_dictionaries_of_any_size(spark):
    rows = spark.range(40).select(F.lit(1).alias("inode_id"), F.col("id").alias("sector"), F.when(F.col("id") % 3 > 0, (F.col("id") % 5).cast("string")).alias("suffix_hash"))
    entries = spark.createDataFrame([(str(k), bytearray([k])) for k in range(4)], "hash string, data binary")
    for most in (0, 1 << 20):
        got = {r.sector: r._suffix for r in sectors._with_contents(rows, "suffix", entries, most).collect()}
        assert got == {k: bytes([k % 5]) if k % 3 and k % 5 < 4 else None for k in range(40)}


def test_sectors_are_made_in_bounded_parts(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert store._cd(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_parity_is_computed_where_the_code_agrees(monkeypatch):
    heads = np.random.default_rng(5).integers(0, 256, (6, 2064), dtype=np.uint8)
    whole = np.concatenate((heads, digests._suffix(heads, False)), axis=1)
    whole[1:5, 2064] ^= 1
    whole[5, 2351] ^= 1
    seen = []
    right = digests.ecc_of
    monkeypatch.setattr(digests, "ecc_of", lambda x: seen.append(len(x)) or right(x))
    assert digests._agree(whole, 2064, False).tolist() == [True] + [False] * 5 and seen == [2]


def test_new_sectors_are_found_in_a_fixed_number_of_parts(spark, sf):
    df = Q["hash_verify"](spark, sf)
    assert "BroadcastHashJoin [inode_id" not in (plan := df._jdf.queryExecution().executedPlan().toString())
    assert plan.count("REPARTITION_BY_NUM") == 3
