"""Token ids in binary files: every id takes the fewest bits that the vocabulary needs.

A file holds a header, blocks of BLOCK ids packed from the lowest bit on (each block starts at a byte), then an index:
the byte offset of each block, and the id, first token and token count of each document. A reader unpacks any block
with numpy alone, so a document is read without what stands before it.

Documents are dealt out by ranges of (id, hash of the text), sorted within each range, and every range is written by
one task as one file under a name of its own, first elsewhere and then renamed, so that a repeated or doubled task
leaves one whole file. The manifest (one row a file) is stored in the shared folder before anything reads it. Where a
document starts in the whole collection is its file's start, a running sum over the manifest, plus its place in it.

Defined results: a null text is encoded like an empty one, to the end id alone; texts of any length are encoded whole;
repeated ids stand in the order of their texts' hashes; null ids come first; an empty table gives an empty table and no
file; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultlens.llm.bpe import byte_letters
from vaultlens.llm.common import cut, ship
from vaultlens.llm.common import folder as new_folder

MAGIC = b"VLTOK001"
BLOCK = 4096
#: Runs of text that a worker remembers the ids of, in each of two tables.
CACHE_RUNS = 700_000
_HEAD = struct.Struct("<8sII")
_TAIL = struct.Struct("<QQQQ8s")
_NULL_ID = -(1 << 63)


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = raw[byte].astype(np.uint64)
    for k in range(1, (bits + 7 + 7) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Writes one file; only an unfinished block and the index are held."""

    def __init__(self, out, bits: int, block: int = BLOCK) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.rest = np.empty(0, np.uint32)
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.tokens = 0
        out.write(_HEAD.pack(MAGIC, bits, block))
        self.at = _HEAD.size

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((_NULL_ID if doc_id is None else doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        held = np.concatenate((self.rest, ids))
        whole = len(held) // self.block * self.block
        for k in range(0, whole, self.block):
            self._block(held[k : k + self.block])
        self.rest = held[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes())
        self.out.write(_TAIL.pack(self.at, len(self.offsets), len(self.docs), self.tokens, MAGIC))


class Reader:
    """Reads one file by its index."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0)
        magic, self.bits, self.block = _HEAD.unpack(file.read(_HEAD.size))
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - _TAIL.size)
        self.end, blocks, docs, self.tokens, again = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a whole token file")
        file.seek(self.end)
        self.offsets = np.frombuffer(file.read(8 * blocks), "<u8")
        self.docs = np.frombuffer(file.read(24 * docs), "<i8").reshape(-1, 3)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the file; touches their blocks only."""
        if not n:
            return np.empty(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        lo = int(self.offsets[first])
        hi = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        self.file.seek(lo)
        data = self.file.read(hi - lo)
        parts = []
        for b in range(first, last + 1):
            at = int(self.offsets[b]) - lo
            count = min(self.block, self.tokens - b * self.block)
            parts.append(unpack(data[at : at + (count * self.bits + 7) // 8], self.bits, count))
        return np.concatenate(parts)[start - first * self.block :][:n]


# Encoding

#: Characters of texts whose words Python's own classes tell apart as the tokenizer's pattern does.
_NOT_PLAIN = re.compile("[^\\n -~\\u00a1-\\u00ac\\u00ae-\\u00b1\\u00b4\\u00b6-\\u00b8\\u00bb\\u00bf-\\u017e\\u2010-\\u2027\\u2030-\\u203a\\u20ac]")
_CROWDED = ("  ", "\n ", " \n", "\n\n")
#: Fixed value: the words of the splitting pattern in a run of plain characters.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[^\\W\\d_]+| ?\\d+| ?(?:[^\\s\\w]|_)+").findall


class Encoder:
    """The tokenizer library's ids of texts.

    The splitting pattern keeps a run without spaces, with the space before it, apart from its neighbours wherever
    white space stands alone. So each different run is encoded once and its ids are put together again. Splitting costs
    the library more than merging, so a run is split into its words here and only these go to the library's model.
    Texts with special tokens, unusual characters or crowded white space go to the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        # Line ends stay: they separate the words of one translation.
        self.letters = {b: c for b, c in byte_letters().items() if b != 10}
        self.runs: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        if len(self.runs) + len(new) > CACHE_RUNS:
            self.old, self.runs = self.runs, {}
        runs, old = self.runs, self.old
        split: dict[str, list[str]] = {}
        ask = []
        for r in new:
            known = old.get(r)
            if known is not None:
                runs[r] = known
                continue
            words = _WORDS(r)
            if len(words) == 1 and words[0] == r:
                ask.append(r)
            elif "".join(words) == r:
                split[r] = words
            else:
                runs[r] = self._ids(r)
        for w in {w for words in split.values() for w in words}.difference(ask):
            if w not in runs:
                known = old.get(w)
                if known is None:
                    ask.append(w)
                else:
                    runs[w] = known
        tokenize = self.model.tokenize
        spelled = "\n".join(ask).encode("utf-8").decode("latin-1").translate(self.letters).split("\n") if ask else []
        for w, s in zip(ask, spelled, strict=True):
            runs[w] = array("I", [t.id for t in tokenize(s)]).tobytes()
        for r, words in split.items():
            runs[r] = b"".join([runs[w] for w in words])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _NOT_PLAIN.search(text) or any(t in text for t in self.special) or any(c in text for c in _CROWDED):
            return self._ids(text)
        runs = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        ids = list(map(self.runs.get, runs))
        if None in ids:
            lost = [k for k, x in enumerate(ids) if x is None]
            self._learn(list({runs[k] for k in lost}))
            for k in lost:
                ids[k] = self.runs[runs[k]]
        return b"".join(ids)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(uri: str):
    """A file system and the path in it, for a folder that all executors see."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, path: str, vocabulary: int, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files; the manifest: part, file, docs, tokens, start (tokens of all files before)."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    folder = (folder or new_folder(spark, "tokens")).replace("file:///", "file:/").replace("file:/", "file:///")
    bits = max(1, (vocabulary - 1).bit_length())

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, out, task = _encoder(path), None, TaskContext.get()
        part = task.partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        for pdf in parts:
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                if out is None:
                    store, base = _store(folder)
                    store.create_dir(base, recursive=True)
                    draft = f"{base}/.draft-{part}-{task.taskAttemptId()}"
                    sink = store.open_output_stream(draft)
                    out = Writer(sink, bits)
                out.add(None if pd.isna(i) else int(i), np.frombuffer(encoder.encode(t or "") + tail, "<u4"))
        if out is not None:
            out.close()
            sink.close()
            name = f"{base}/part-{part:06d}.tok"
            store.move(draft, name)
            yield pd.DataFrame({"part": [part], "file": [f"part-{part:06d}.tok"], "docs": [len(out.docs)], "tokens": [out.tokens]})

    ranged = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    manifest = cut(ranged.mapInPandas(write, "part long, file string, docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", F.concat(F.lit(folder + "/"), "file").alias("file"), "docs", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    import zlib

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for uri, base in zip(pdf["file"], pdf["start"], strict=True):
                store, path = _store(uri)
                with store.open_input_file(path) as f:
                    r = Reader(f)
                    for k in range(0, len(r.docs), 1024):
                        docs = r.docs[k : k + 1024]
                        crc, held, at = [], np.empty(0, "<u4"), int(docs[0, 1])
                        for _, s, n in docs.tolist():
                            if s + n > at + len(held):
                                held, at = r.read(s, max(n, min(1 << 18, r.tokens - s))), s
                            crc.append(zlib.crc32(held[s - at : s - at + n].tobytes()))
                        ids = pd.array(docs[:, 0], dtype="Int64")
                        ids[docs[:, 0] == _NULL_ID] = pd.NA
                        yield pd.DataFrame({"doc_id": ids, "start": docs[:, 1] + int(base), "n_tokens": docs[:, 2], "ids_crc32": np.array(crc, np.int64)})

    files = manifest.select("file", "start")
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
