"""Images of any size as sectors: a data source that reads byte ranges, so one file is read by many tasks and never held whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vaultlens.sources.model import SECTOR_SIZES

NAME = "image_sectors"
#: Sectors that one task reads, and bytes read at a time.
PER_TASK, CHUNK = 1 << 17, 1 << 22


@dataclass
class Range(InputPartition):
    path: str
    sector_size: int
    first: int
    count: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sector_size_of(name: str) -> int | None:
    """By the extension after the last dot; none for names that start with their only dot."""
    stem, dot, ext = name.rpartition(".")
    return SECTOR_SIZES.get(ext.lower()) if dot and stem else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per_task = options["path"], int(options.get("sectorspertask", PER_TASK))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, base = _store(self.path)
        info = store.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File), key=lambda f: f.path):
            size = sector_size_of(f.base_name)
            sectors = -(-f.size // size) if size else 0
            out += [Range(f.path, size, k, min(self.per_task, sectors - k)) for k in range(0, sectors, self.per_task)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        step = max(1, CHUNK // part.sector_size)
        with store.open_input_file(part.path) as f:
            for k in range(part.first, part.first + part.count, step):
                f.seek(k * part.sector_size)
                data = f.read(min(step, part.first + part.count - k) * part.sector_size)
                for i in range(0, len(data), part.sector_size):
                    yield part.path, k + i // part.sector_size, part.sector_size, data[i : i + part.sector_size]


class ImageSectors(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, sector long, sector_size int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def image_sectors(spark: SparkSession, path: str, per_task: int = PER_TASK) -> DataFrame:
    """path, sector, sector_size, data of the image files under a path that Arrow's file systems know."""
    spark.dataSource.register(ImageSectors)
    return spark.read.format(NAME).option("sectorsPerTask", per_task).load(path)
