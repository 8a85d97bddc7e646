"""Readers of binary images and of the key/value files that lie beside them.

Files come through Spark's binaryFile source, so any file system Spark knows will do, and each file is parsed in the task
that read it. Parsers return long metadata rows or sectors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.functions.scalar import extension, labelled
from vaultlens.sources.model import SECTOR_SIZES


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sector_size, data of the image files under a folder, by their extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = F.lit(None).cast("int")
    for ext, n in SECTOR_SIZES.items():
        size = F.when(extension(F.regexp_extract("path", "([^/]*)$", 1)) == ext, F.lit(n)).otherwise(size)
    return files.select("path", size.alias("sector_size"), F.col("content").alias("data")).where("sector_size IS NOT NULL")


def sfo_entries(data: bytes) -> list[tuple[str, str]]:
    """Keys and values of a PARAM.SFO file: texts and 32-bit numbers; other kinds are left out, 32 entries count at most."""
    if len(data) < 20 or data[:4] != b"\0PSF":
        return []
    keys, values, count = struct.unpack_from("<III", data, 8)
    out = []
    for at in range(20, 20 + 16 * min(count, 32), 16):
        if at + 16 > len(data):
            break
        key_at, kind, used, _, value_at = struct.unpack_from("<HHIII", data, at)
        if keys + key_at >= len(data) or values + value_at >= len(data):
            continue
        key = data[keys + key_at :].split(b"\0", 1)[0].decode("utf-8", "replace")
        raw = data[values + value_at : values + value_at + used]
        if kind in (0x0204, 0x0004):
            out.append((key, raw.rstrip(b"\0").decode("utf-8", "replace")))
        elif kind == 0x0404 and used == 4 and len(raw) == 4:
            out.append((key, str(struct.unpack("<I", raw)[0])))
    return out


def ird_entries(data: bytes) -> list[tuple[str, str]]:
    """Identity fields of an IRD file, which may be compressed with gzip."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    if data[:4] != b"3IRD" or len(data) < 15:
        return []
    version, at = data[4], 5
    game, at = data[at : at + 9].decode("ascii", "replace"), at + 9
    size, at = data[at], at + 1
    title, at = data[at : at + size].decode("utf-8", "replace"), at + size
    out = [("GameID", game), ("Title", title), ("IrdVersion", str(version))]
    for name, n in (("UpdateVersion", 4), ("GameVersion", 5), ("AppVersion", 5)):
        out.append((name, data[at : at + n].decode("ascii", "replace").rstrip("\0")))
        at += n
    return out


def wux_sectors(data: bytes) -> list[int]:
    """The physical sector of each logical sector of a WUX file; its contents follow the table."""
    if data[:8] != b"WUX0\x2e\xd0\x99\x10":
        return []
    size, _, total = struct.unpack_from("<IIQ", data, 8)
    return list(struct.unpack_from(f"<{-(-total // size)}I", data, 32))


def key_values(files: DataFrame, parser: Callable[[bytes], list[tuple[str, str]]]) -> DataFrame:
    """path, key, value of files (path, data or content)."""
    data = "data" if "data" in files.columns else "content"

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, k, v) for p, d in zip(pdf["path"], pdf[data], strict=True) for k, v in parser(bytes(d))]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.select("path", data).mapInPandas(parse, "path string, key string, value string")


def iso_entries(data: bytes, sector: int = 2048) -> list[tuple[str, int, int]]:
    """path, first byte and size of every file of an ISO 9660 image, walked from its root directory."""
    if data[16 * sector + 1 : 16 * sector + 6] != b"CD001":
        return []
    root = data[16 * sector + 156 : 16 * sector + 190]
    out: list[tuple[str, int, int]] = []
    todo, seen = [("", *struct.unpack_from("<I4xI", root, 2))], set()
    while todo:
        base, lba, size = todo.pop()
        if lba in seen:
            continue
        seen.add(lba)
        at, end = lba * sector, min(lba * sector + size, len(data))
        while at + 33 < end:
            length = data[at]
            if not length:
                at = (at // sector + 1) * sector
                continue
            where, n, flags, name_len = *struct.unpack_from("<I4xI", data, at + 2), data[at + 25], data[at + 32]
            name = data[at + 33 : at + 33 + name_len]
            if name not in (b"\0", b"\1"):
                path = f"{base}/{name.decode('ascii', 'replace').split(';')[0]}"
                if flags & 2:
                    todo.append((path, where, n))
                else:
                    out.append((path, where * sector, n))
            at += length
    return sorted(out)


def iso_files(images: DataFrame) -> DataFrame:
    """image, path, offset, size of the files inside ISO images (path, data)."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(p, *e) for p, d in zip(pdf["path"], pdf["data"], strict=True) for e in iso_entries(bytes(d))]
            yield pd.DataFrame(rows, columns=["image", "path", "offset", "size"])

    return images.select("path", "data").mapInPandas(walk, "image string, path string, offset long, size long")


def disc_identity(images: DataFrame) -> DataFrame:
    """Long metadata of GameCube and Wii images from their first bytes: identifier, maker, disc number and version, region."""
    head = F.substring("data", 1, 32)
    text = F.decode(F.substring(head, F.lit(1), F.lit(6)), "US-ASCII")
    region = labelled(F.substring(text, F.lit(4), F.lit(1)), {"E": "USA", "J": "Japan", "P": "Europe"})
    number = F.conv(F.hex(F.substring(head, F.lit(7), F.lit(1))), 16, 10)
    version = F.conv(F.hex(F.substring(head, F.lit(8), F.lit(1))), 16, 10)
    pairs = {"GameID": text, "MakerCode": F.substring(text, F.lit(5), F.lit(2)), "DiscNumber": number, "DiscVersion": version, "Region": region}
    return images.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])).alias("p")).select("path", "p.key", "p.value")


def region_map(data: bytes) -> list[tuple[int, int]]:
    """First and last sectors of the plain regions that a disc's first sector lists (big-endian; 32 at most)."""
    if len(data) < 8:
        return []
    count = min(struct.unpack_from(">I", data, 0)[0], 32)
    at = [8 + 8 * k for k in range(count) if 16 + 8 * k <= len(data)]
    return [struct.unpack_from(">II", data, k) for k in at]


def physical(logical: DataFrame, table: DataFrame) -> DataFrame:
    """logical sectors (inode_id, sector) with where a compressed image keeps them; table is (inode_id, sector, physical)."""
    return logical.join(table, ["inode_id", "sector"])
