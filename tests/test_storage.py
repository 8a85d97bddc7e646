"""Attributes, volumes, junk regions, checksums and parity."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vaultlens.functions import digests
from vaultlens.operators import inodes, junk
from vaultlens.sources import binary


def test_inodes(spark):
    t = spark.createDataFrame([(1, 7, 100), (2, 7, 200)], "inode_id long, mode long, file_size long")
    change = spark.createDataFrame([(2, 8, 5, 1), (2, 9, 6, 2), (3, 1, 1, 1)], "inode_id long, mode long, file_size long, version long")
    assert sorted(map(tuple, inodes.put(t, change).collect())) == [(1, 7, 100), (2, 9, 6), (3, 1, 1)]
    assert inodes.updated(t, 1, mode=5).where("inode_id = 1").first().mode == 5
    assert inodes.truncated(t, 2, 0).where("inode_id = 2").first().file_size == 0
    assert inodes.delete(t, t.where("inode_id = 1")).count() == 1


def test_attributes(spark):
    meta = spark.createDataFrame([(1, "Title", "x")], "inode_id long, key string, value string")
    tags = spark.createDataFrame([(1, 5, bytearray(b"\1\2"))], "inode_id long, tag_type int, data binary")
    assert {r.name for r in inodes.attribute_names(meta, tags, 1).collect()} == {"user.metadata.Title", "user.mediatag.5"}
    assert bytes(inodes.attribute(meta, tags, 1, "user.metadata.Title").first().value) == b"x"
    assert bytes(inodes.attribute(meta, tags, 1, "user.mediatag.5").first().value) == b"\1\2"
    assert inodes.attribute(meta, tags, 1, "other").count() == 0


def test_volume(spark, tmp_path):
    inodes.create_volume(spark, str(tmp_path / "v"))
    assert inodes.check_volume(spark, str(tmp_path / "v")).count() == 0
    assert inodes.check_volume(spark, str(tmp_path / "none")).count() > 0


def test_digests(spark):
    rows = [(b"",), (b"abc",), (None,)]
    df = spark.createDataFrame(rows, "d binary")
    got = df.select("d", digests.xxh64(F.col("d")).alias("x"), digests.checksum32(F.col("d")).alias("c")).collect()
    for r in got:
        if r.d is None:
            assert r.x is None
        else:
            want = xxhash.xxh64_intdigest(bytes(r.d))
            assert r.x % (1 << 64) == want and bytes(r.c) == want.to_bytes(8, "little") + bytes(24)


def test_parity_code_words_vanish(spark):
    rng = np.random.default_rng(1)
    head = bytes(12) + bytes(rng.integers(0, 256, 2052, dtype=np.uint8))
    tail = bytes(spark.createDataFrame([(bytearray(head),)], "d binary").select(digests.mode1_suffix(F.col("d")).alias("s")).first().s)
    raw = head + tail
    assert len(raw) == 2352
    # A code over a message followed by its own code is zero.
    assert digests.edc_of(np.frombuffer(raw[:2068], np.uint8)[None])[0] == 0
    spoiled = bytearray(raw)
    spoiled[100] ^= 1
    df = spark.createDataFrame([(bytearray(raw), True), (spoiled, False), (bytearray(b"short"), False)], "d binary, good boolean")
    assert all(r.g == r.good for r in df.select("good", digests.suffix_is_regenerable(F.col("d")).alias("g")).collect())


def test_junk_round_trip(spark):
    def generator(seed, at, size):
        return bytes((seed + at + k) % 251 for k in range(size))

    rows = [(1, s, 4, bytearray(generator(9, 4 * s, 4) if s in (0, 2, 3, 5) else bytes([s] * 4))) for s in range(7)]
    df = spark.createDataFrame(rows, "inode_id long, sector long, sector_size int, data binary")
    regions = spark.createDataFrame([(1, 16, 8)], "inode_id long, offset long, length long")
    seeds = spark.createDataFrame([(1, 9)], "inode_id long, seed int")
    kept, runs = junk.elided(df, regions, seeds, generator, 64)
    assert {(r.offset, r.length) for r in runs.collect()} == {(0, 4), (8, 8)}
    assert sum(bytes(r.data) == bytes(4) for r in kept.collect()) == 3
    back = junk.regenerated(kept, runs, generator, 64)
    assert {r.sector: bytes(r.data) for r in back.collect()} == {s: bytes(d) for _, s, _, d in rows}


def test_region_map():
    import struct

    assert binary.region_map(struct.pack(">IIIIII", 2, 0, 0, 10, 20, 30)) == [(0, 10), (20, 30)]
    assert binary.region_map(b"") == []
