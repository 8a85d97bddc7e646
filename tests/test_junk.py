"""The junk generator, seeds found from its bytes, and sectors that are enciphered one by one."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from vaultlens.functions import digests, lagged
from vaultlens.operators import junk, sectors


def _slow(seed: bytes, size: int) -> bytes:
    """The generator's definition, word by word."""
    x = list(struct.unpack(">17I", seed))
    for n in range(17, 521):
        x.append((x[n - 17] << 23 & 0xFFFFFFFF) ^ x[n - 16] >> 9 ^ x[n - 1])
    x = [v & 0xFF00FFFF | v >> 2 & 0xFF0000 for v in x]
    while len(x) < 4 * 521 + size // 4 + 1:
        x.append(x[-521] ^ x[-32])
    return struct.pack(f">{len(x) - 4 * 521}I", *x[4 * 521 :])[:size]


@pytest.mark.parametrize("n", range(3))
def test_stream_and_seed(n):
    r = random.Random(n)
    seed = r.randbytes(68)
    made = _slow(seed, 9000)
    assert lagged.stream(seed, 0, 9000) == made and lagged.stream(seed, 5, 77) == made[5:82] and lagged.stream(seed, 8, 0) == b""
    for at, size in ((0, 2084), (3, 2087), (4096, 4096), (6001, 2999)):
        found = lagged.seed_of(made[at : at + size], at)
        assert found[4:] == seed[4:] and lagged.stream(found, 0, 9000) == made
    assert lagged.seed_of(made[:2083]) is None
    assert lagged.seed_of(made[:3000] + bytes([made[3000] ^ 1]) + made[3001:]) is None
    assert lagged.seed_of(made[4:], 0) is None and lagged.seed_of(r.randbytes(4000)) is None and lagged.seed_of(b"") is None


def test_errors():
    with pytest.raises(ValueError):
        lagged.stream(b"short", 0, 4)
    with pytest.raises(ValueError):
        lagged.repeating(64)(bytes(68), 60, 8)


def test_blocks_round_trip(spark):
    r = random.Random(7)
    size, generator = 4096, lagged.repeating(4096)
    seeds = [r.randbytes(68) for _ in range(3)]
    rows = []
    for s in range(24):  # three blocks of eight sectors of 512 bytes; a damaged sector in the second, nothing but other data in the third
        data = generator(seeds[s // 8], s * 512, 512) if s < 16 and s not in (0, 10) else r.randbytes(512)
        rows.append((1, s, 512, bytearray(data)))
    rows += [(2, 0, 512, None), (2, 1, 512, bytearray())]
    df = spark.createDataFrame(rows, "inode_id long, sector long, sector_size int, data binary")
    regions = spark.createDataFrame([(1, 0, 512)], "inode_id long, offset long, length long")
    found = junk.recovered_seeds(df, regions, size, 1024)
    got = {(x.inode_id, x.block): bytes(x.seed) for x in found.collect()}
    assert set(got) == {(1, 0), (1, 1)} and all(got[1, k][4:] == seeds[k][4:] for k in range(2))
    kept, runs = junk.elided(df, regions, found, generator, 1024, size)
    assert {(x.offset, x.length) for x in runs.collect()} == {(512, 3584), (4096, 1024), (5632, 2560)}
    assert sum(bytes(x.data or b"") == bytes(512) for x in kept.collect()) == 14
    back = junk.regenerated(kept, runs, generator, 1024)
    assert {(x.inode_id, x.sector): x.data and bytes(x.data) for x in back.collect()} == {(i, s): d and bytes(d) for i, s, _, d in rows}
    assert junk.recovered_seeds(df.limit(0), regions, size, 1024).count() == 0


def test_deciphered(spark):
    key = bytes(range(16))
    plain = {s: bytes([s]) * 32 for s in range(5)}
    closed = {s: d if s < 2 else digests.aes_cbc(d, key, s.to_bytes(16, "big"), False) for s, d in plain.items()}
    df = spark.createDataFrame([(i, s, bytearray(d)) for i in (1, 2) for s, d in closed.items()], "inode_id long, sector long, data binary")
    regions = spark.createDataFrame([(1, 0, 1)], "inode_id long, start_sector long, end_sector long")
    keys = spark.createDataFrame([(1, bytearray(key))], "inode_id long, key binary")
    got = {(x.inode_id, x.sector): bytes(x.data) for x in sectors.deciphered(df, regions, keys).collect()}
    assert got == {(1, s): d for s, d in plain.items()} | {(2, s): d for s, d in closed.items()}
    held, start = bytes(range(16, 32)), bytes(16)
    one = spark.range(1).select(digests.derived_key(F.lit(held), F.lit(key), F.lit(start)).alias("k")).first().k
    assert bytes(one) == digests.aes_cbc(held, key, start, False)


def test_aes_rows_of_several_keys_and_lengths(spark):
    r = random.Random(3)
    keys = [r.randbytes(16) for _ in range(3)]
    rows = [(i, bytearray(r.randbytes(16 * (i % 4))), bytearray(keys[i % 3]), bytearray(r.randbytes(16))) for i in range(20)] + [(20, None, bytearray(keys[0]), bytearray(16)), (21, bytearray(16), None, bytearray(16))]
    df = spark.createDataFrame(rows, "i int, d binary, k binary, v binary").coalesce(1)
    sealed = df.withColumn("e", digests.aes(F.col("d"), F.col("k"), F.col("v"), False))
    for x in sealed.withColumn("o", digests.aes(F.col("e"), F.col("k"), F.col("v"))).collect():
        if x.d is None or x.k is None:
            assert x.e is None and x.o is None
        else:
            assert x.o == x.d and bytes(x.e) == b"".join(_chained(bytes(x.d), bytes(x.k), bytes(x.v)))


def _chained(data, key, iv):
    """CBC block by block, each by itself."""
    for k in range(0, len(data), 16):
        iv = digests.aes_cbc(bytes(a ^ b for a, b in zip(data[k : k + 16], iv, strict=True)), key, bytes(16), False)
        yield iv
