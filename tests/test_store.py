"""Stored blocks, images read by ranges, disc formats, AES, attributes, cloning and result pages."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlens.functions import digests
from vaultlens.functions.lineage import numbered
from vaultlens.operators import blocks, export, hierarchy, inodes, metadata, sectors
from vaultlens.plans import catalogue
from vaultlens.sources import binary, ranges


def test_aes_published_vectors():
    """SP 800-38A, F.2.1 and F.2.2."""
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710")
    sealed = bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b273bed6b8e3c1743b7116e69e222295163ff1caa1681fac09120eca307586e1a7")
    assert digests.aes_cbc(plain, key, iv, False) == sealed and digests.aes_cbc(sealed, key, iv, True) == plain
    assert digests.aes_cbc(b"", key, iv, True) == b""
    with pytest.raises(ValueError):
        digests.aes_cbc(b"x", key, iv, True)


def test_aes_rows(spark):
    rows = [(bytearray(range(32)), bytearray(b"k" * 16), bytearray(b"v" * 16)), (None, bytearray(b"k" * 16), bytearray(b"v" * 16))]
    df = spark.createDataFrame(rows, "d binary, k binary, v binary")
    got = df.select(digests.aes(digests.aes(F.col("d"), F.col("k"), F.col("v"), False), F.col("k"), F.col("v")).alias("x")).collect()
    assert [r.x and bytes(r.x) for r in got] == [bytes(range(32)), None]


def test_cd_form1_round_trip(spark):
    """Computed suffixes aren't stored in modes 1 and 2 form 1, spoiled ones are; sectors come back byte by byte."""
    rng = np.random.default_rng(2)

    def raw(lba, mode, spoil=False):
        m = lba + 150
        head = b"\0" + b"\xff" * 10 + b"\0" + bytes(int(str(x), 16) for x in (m // 4500, m % 4500 // 75, m % 75)) + bytes([1 if mode == 1 else 2])
        body = bytes(rng.integers(0, 256, 2048 if mode == 1 else 2056, dtype=np.uint8))
        whole = np.frombuffer(head + body, np.uint8)[None]
        out = head + body + digests._suffix(whole, mode == 3).tobytes()
        return out[:-1] + bytes([out[-1] ^ 1]) if spoil else out

    rows = [(1, k, m, bytearray(raw(k, m, k % 3 == 2)), None) for k, m in enumerate([1, 1, 1, 3, 3, 3])]
    cut = sectors.cd_split(spark.createDataFrame(rows, "inode_id long, sector long, mode int, data binary, subchannel binary")).cache()
    assert [r.generated_suffix for r in cut.orderBy("sector").collect()] == [True, True, False] * 2
    parts = {p: sectors.dictionary(cut, p) for p in ("user_data", "prefix", "suffix")}
    assert parts["suffix"].count() == 2 and {len(r.data) for r in parts["suffix"].collect()} == {288, 280}
    back = sectors.cd_rebuilt(cut, parts["user_data"], parts["prefix"], parts["suffix"], spark.createDataFrame([(1, 6)], "inode_id long, sectors int"))
    assert {r.sector: bytes(r.data) for r in back.collect()} == {r[1]: bytes(r[3]) for r in rows}


def test_blocks(spark):
    rng = random.Random(3)
    values = [rng.randbytes(2000), b"text " * 400, b"", None, rng.randbytes(1000) + bytes(300)]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in enumerate(values)], "k int, v binary")
    got = {r.k: r.w for r in df.select("k", blocks.worth_compressing(F.col("v"), 9).alias("w")).collect()}
    assert got == {k: bool(v) and 100 * len(zlib.compress(v, 1)) <= 90 * len(v) for k, v in enumerate(values)} and got[1] and not got[0]
    assert {r.w for r in df.select(blocks.worth_compressing(F.col("v"), 3).alias("w")).collect()} == {True}
    stored = spark.createDataFrame([(1, "BLCK", bytearray(b"abc")), (2, "BLCK", bytearray(b"abd")), (3, "XXXX", bytearray(b"abc")), (4, None, None)], "lba long, magic string, payload binary")
    good = stored.select(digests.xxh64(F.lit("abc").cast("binary")).alias("c")).first().c
    assert {(r.lba, r.fault) for r in blocks.scrub(stored.withColumn("checksum", F.lit(good))).collect()} == {(2, "checksum"), (3, "magic"), (4, "magic")}
    none = spark.createDataFrame([], "lba long, header_bytes long, original_bytes long, stored_bytes long")
    assert blocks.physical(none, 4096).first().physical_bytes == 0 and blocks.compression(none, 4096).first().ratio_hundredths is None


def test_images_are_read_by_ranges(spark, tmp_path):
    """Several tasks share a file; the last sector may be short; other files are left out."""
    rng = random.Random(4)
    files = {"a.ISO": rng.randbytes(2048 * 70 + 5), "sub/b.img": rng.randbytes(512 * 9), "c.txt": b"no", ".iso": b"no", "empty.dsk": b""}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    df = ranges.image_sectors(spark, str(tmp_path), per_task=16)
    assert df.rdd.getNumPartitions() == 6
    got: dict = {}
    for r in df.orderBy("path", "sector").collect():
        got.setdefault(r.path.removeprefix(f"{tmp_path}/"), []).append(bytes(r.data))
    assert {k: b"".join(v) for k, v in got.items()} == {k: files[k] for k in ("a.ISO", "sub/b.img")} and len(got["a.ISO"]) == 71
    smap = ranges.image_sectors(spark, f"{tmp_path}/sub/b.img").select(F.lit(1).cast("long").alias("inode_id"), "sector", "sector_size", "data", F.md5("data").alias("hash"))
    assert sectors.new_places(smap, spark.createDataFrame([], "sector_size int, hash string")).count() == 9


def iso(files):
    """A small ISO 9660 image: the root directory holds one file and a directory with the others."""

    def record(name, lba, size, flags):
        body = struct.pack("<BBI4xI4x7xBBBHHB", 33 + len(name) + (len(name) + 1) % 2, 0, lba, size, flags, 0, 0, 1, 0, len(name)) + name
        return body + bytes(body[0] - len(body))

    (first, a), *rest = files.items()
    at, places = 20, {}
    for name, data in files.items():
        places[name] = at
        at += -(-len(data) // 2048)
    root = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(first.encode() + b";1", places[first], len(a), 0) + record(b"DIR", 19, 2048, 2)
    below = record(b"\0", 19, 2048, 2) + record(b"\1", 18, 2048, 2) + b"".join(record(n.encode() + b";1", places[n], len(d), 0) for n, d in rest)
    head = bytearray(2048)
    head[:7] = b"\1CD001\1"
    head[156:190] = record(b"\0", 18, 2048, 2)
    return bytes(16 * 2048) + bytes(head) + bytes(2048) + root.ljust(2048, b"\0") + below.ljust(2048, b"\0") + b"".join(d.ljust(-(-len(d) // 2048) * 2048, b"\0") for d in files.values())


def test_iso_files(spark, tmp_path):
    files = {"README.TXT": b"hello", "A.BIN": bytes(range(256)) * 20, "PARAM.SFO": b"x" * 10}
    image = iso(files)
    want = {"/README.TXT": "README.TXT", "/DIR/A.BIN": "A.BIN", "/DIR/PARAM.SFO": "PARAM.SFO"}
    found = binary.iso_entries(image)
    assert {p: image[at : at + n] for p, at, n in found} == {p: files[n] for p, n in want.items()}
    (tmp_path / "disc.iso").write_bytes(image)
    rows = binary.iso_files(binary.image_files(spark, str(tmp_path))).collect()
    assert {(r.path, r.offset, r.size) for r in rows} == set(found)


def test_wux_and_ird(spark):
    logical = [b"a", b"b", b"a", b"c"]
    table = [0, 1, 0, 2]
    wux = b"WUX0\x2e\xd0\x99\x10" + struct.pack("<IIQQ", 16, 0, 64, 0) + struct.pack("<4I", *table)
    assert binary.wux_sectors(wux) == table
    t = spark.createDataFrame([(1, k, p) for k, p in enumerate(table)], "inode_id long, sector long, physical long")
    held = spark.createDataFrame([(1, k) for k in range(4)], "inode_id long, sector long")
    kept = {0: b"a", 1: b"b", 2: b"c"}
    assert [kept[r.physical] for r in binary.physical(held, t).orderBy("sector").collect()] == logical
    ird = b"3IRD" + bytes([9]) + b"BLUS12345" + bytes([5]) + b"Title" + b"4.11" + b"01.00" + b"01.02"
    want = [("GameID", "BLUS12345"), ("Title", "Title"), ("IrdVersion", "9"), ("UpdateVersion", "4.11"), ("GameVersion", "01.00"), ("AppVersion", "01.02")]
    assert binary.ird_entries(ird) == want
    packer = zlib.compressobj(wbits=31)
    assert binary.ird_entries(packer.compress(ird) + packer.flush()) == want


def test_attributes_change(spark):
    meta = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "inode_id long, key string, value string")
    tags = spark.createDataFrame([(1, 5, bytearray(b"t"))], "inode_id long, tag_type smallint, data binary")
    m, t = inodes.with_attribute(meta, tags, 1, "user.metadata.a", "é".encode())
    assert {tuple(r) for r in m.collect()} == {(1, "a", "é"), (2, "a", "y")}
    m, t = inodes.with_attribute(m, t, 1, "user.mediatag.5", b"new")
    assert bytes(inodes.attribute(m, t, 1, "user.mediatag.5").first().value) == b"new" and t.count() == 1
    m, t = inodes.without_attribute(m, t, 1, "user.mediatag.5")
    assert t.count() == 0 and m.count() == 2
    for name in ("user.metadata.", "user.mediatag.68", "user.mediatag.x", "other"):
        with pytest.raises(KeyError):
            inodes.with_attribute(meta, tags, 1, name, b"v")


def test_clones_are_whole_blocks(spark):
    x = spark.createDataFrame([(1, 0, 10, 4), (2, 0, 50, 6), (3, 0, 90, 1)], "inode_id long, logical_offset long, start_block long, count long")
    after = {tuple(r) for r in sectors.cloned_extents(x, 1, 2, 4096, 8192, 4096).collect()}
    assert after == {(1, 0, 10, 4), (3, 0, 90, 1), (2, 0, 50, 1), (2, 1, 11, 2), (2, 3, 53, 3)}
    for bad in ((1, 1, 0, 4096), (1, 2, 5, 4096), (1, 2, 0, 100), (1, 2, 0, 0)):
        with pytest.raises(ValueError):
            sectors.cloned_extents(x, *bad, 4096)


def test_one_path(spark):
    c = spark.createDataFrame([(2, 2, True, ""), (3, 2, True, "a"), (4, 3, True, "b"), (5, 4, False, "f")], "inode_id long, parent_id long, is_dir boolean, name string")
    assert [hierarchy.resolve(c, p) for p in ("/", "/a", "/a/b/f", "a//b/", "/a/x", "/a/b/f/g")] == [2, 3, 5, 4, None, None]


def test_numbers_and_pages(spark):
    ids = spark.range(1000).select((F.col("id") * 7 % 1000).alias("inode_id")).repartition(7)
    assert {r.inode_id: r.position for r in metadata.positions(ids).collect()} == {k: k for k in range(1000)}
    seen, last = [], None
    while page := [r.inode_id for r in metadata.paged(ids.where("inode_id < 20"), last).collect()]:
        seen.append(page)
        last = page[-1]
    assert seen == [list(range(8)), list(range(8, 16)), list(range(16, 20))]
    assert [r.inode_id for r in metadata.page_at(ids, 996).collect()] == [996, 997, 998, 999]
    two = spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int")
    assert {r.k: r.n for r in numbered(two, ["k"], "n").collect()} == {"a": 0, "b": 1}


def test_first_seen_columns(spark):
    rows = [(1, f"k{c:02}", "v") for c in range(5)] + [(2, f"a{c:02}", "v") for c in range(40)]
    meta, ids = spark.createDataFrame(rows, "inode_id long, key string, value string"), spark.createDataFrame([(2,), (1,)], "inode_id long")
    assert metadata.first_seen_keys(ids, meta) == [f"k{c:02}" for c in range(5)] + [f"a{c:02}" for c in range(27)]
    out = metadata.wide(ids, meta)
    assert len(out.columns) == 33 and out.where("inode_id = 1").first().a00 == ""


def test_rendered_aggregates(spark):
    import json

    meta = spark.createDataFrame([(1, "k", "-7"), (2, "k", "2\né\"")], "inode_id long, key string, value string")
    assert [r.value for r in export.group_lines(metadata.group_by(meta, "k")).collect()] == ["  -7   1", "  2    1", "  é\"  1"]
    assert [r.value for r in export.distinct_lines(metadata.distinct(meta, "k")).collect()] == ["-7", "2", 'é"']
    whole = json.loads("".join(export.document("k", "groups", "results", export.group_lines(metadata.group_by(meta, "k"), "json"))))
    assert whole == {"key": "k", "groups": 3, "results": [{"value": v, "count": 1} for v in ("-7", "2", 'é"')]}
    assert json.loads("".join(export.document("k", "count", "values", export.distinct_lines(metadata.distinct(meta, "k"), "json"))))["values"] == ["-7", "2", 'é"']
    stats = json.loads(export.stats_text(metadata.stats(meta, "k"), "k", "json").first().value)
    assert stats == {"key": "k", "count": 3, "min": -7, "max": 2, "sum": -5, "avg": -1.67}
    assert json.loads(export.stats_text(metadata.stats(meta, "none"), "none", "json").first().value)["avg"] is None
    assert "Avg" not in export.stats_text(metadata.stats(meta, "none"), "none").first().value


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())
