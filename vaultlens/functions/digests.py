"""Checksums and parity of binary data that Spark has no function for, in Arrow batches, and those it has."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def xxh64(data: Column) -> Column:
    """XXH64 with seed 0, as a signed long."""

    @F.pandas_udf("long")
    def digest(values: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh64_intdigest(bytes(v)) if v is not None else 0 for v in values], np.uint64).view(np.int64))

    return F.when(data.isNotNull(), digest(data.cast("binary")))


def checksum32(data: Column) -> Column:
    """A 32-byte field: the hash's eight bytes from the lowest on, then zeros."""
    big = F.lpad(F.hex(xxh64(data)), 16, "0")
    little = F.concat(*[F.substring(big, k, 2) for k in range(15, 0, -2)])
    return F.unhex(F.concat(little, F.lit("0" * 48)))


def sha1(data: Column) -> Column:
    return F.sha1(data.cast("binary"))


def _edc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xD8018001 (ECMA-130)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xD8018001), t >> 1)
    return t


_EDC = _edc_table()


def edc_of(rows: np.ndarray) -> np.ndarray:
    """Error detection codes of equally long byte rows, all rows at a time."""
    c = np.zeros(len(rows), np.uint32)
    for at in np.ascontiguousarray(rows.T):
        c = (c >> np.uint32(8)) ^ _EDC[(c ^ at) & 0xFF]
    return c


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms and powers of GF(256) over 0x11D."""
    power, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for k in range(255):
        power[k] = power[k + 255] = x
        log[x] = k
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    return log, power


_LOG, _POWER = _field()


def _times(a: np.ndarray, log_b: int) -> np.ndarray:
    return np.where(a == 0, 0, _POWER[(_LOG[a] + log_b) % 255]).astype(np.uint8)


def _twice(a: np.ndarray) -> np.ndarray:
    return a << np.uint8(1) ^ (a >> np.uint8(7)) * np.uint8(0x1D)


def _parity(words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two check bytes that end each code word: all bytes sum to 0, and so do they weighted with falling powers.

    words: one row for each byte of a sector, one column for each sector; places: for each code word the rows it is made of.
    """
    plain = np.zeros((len(places), words.shape[1]), np.uint8)
    weighted = plain.copy()
    for at in places.T:
        word = words[at]
        plain ^= word
        weighted = _twice(weighted) ^ word
    weighted = _twice(_twice(weighted))
    first = _times(plain ^ weighted, 255 - int(_LOG[2 ^ 1]))  # p * (2 ^ 1) = plain ^ weighted
    return first, plain ^ first


def ecc_of(sectors: np.ndarray) -> np.ndarray:
    """The 276 P and Q parity bytes of raw mode 1 sectors, from their bytes 12 .. 2075 (ECMA-130, annex A)."""
    out = np.empty((len(sectors), 276), np.uint8)
    column = np.arange(86)[:, None] + 86 * np.arange(24)[None]
    start = np.arange(52)
    diagonal = (86 * (start // 2)[:, None] + start[:, None] % 2 + 88 * np.arange(43)[None]) % 2236
    for k in range(0, len(sectors), 512):  # so many that their bytes stay in the processor's cache
        body = np.ascontiguousarray(sectors[k : k + 512, 12:2076].T)
        p0, p1 = _parity(body, column)
        q0, q1 = _parity(np.concatenate((body, p0, p1)), diagonal)
        out[k : k + 512] = np.concatenate((p0, p1, q0, q1)).T
    return out


def per_row(data: Column, kind: str, of: Callable[[np.ndarray], list]) -> Column:
    """of() over the rows of a batch that have the length of its first one, as one array."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        sizes: dict[int, list[int]] = {}
        for k, v in enumerate(values):
            if v is not None:
                sizes.setdefault(len(v), []).append(k)
        for size, at in sizes.items():
            rows = np.frombuffer(b"".join(bytes(values[k]) for k in at), np.uint8).reshape(len(at), size)
            for k, v in zip(at, of(rows), strict=True):
                out[k] = v
        return pd.Series(out, dtype=object)

    return run(data.cast("binary"))


def edc(data: Column) -> Column:
    """The error detection code as a long."""
    return per_row(data, "long", lambda rows: edc_of(rows).astype(np.int64).tolist())


def _suffix(heads: np.ndarray, form1: bool) -> np.ndarray:
    """What follows the data of raw sectors, from their bytes up to there. Mode 1: code, eight zeros, parity; mode 2 form 1: code over subheader and data, parity with the address left out."""
    n = len(heads)
    code = edc_of(heads[:, 16:] if form1 else heads).view(np.uint8).reshape(-1, 4)
    gap = np.zeros((n, 0 if form1 else 8), np.uint8)
    whole = np.concatenate((heads, code, gap, np.zeros((n, 276), np.uint8)), axis=1)
    if form1:
        whole[:, 12:16] = 0
    return np.concatenate((code, gap, ecc_of(whole)), axis=1)


def _agree(rows: np.ndarray, at: int, form1: bool) -> np.ndarray:
    """Whether raw sectors go on from byte `at` as their data says. Parity is computed only where the code, which is cheaper, agrees."""
    if rows.shape[1] != 2352:
        return np.zeros(len(rows), bool)
    code = edc_of(rows[:, 16:at] if form1 else rows[:, :at]).view(np.uint8).reshape(-1, 4)
    out = (rows[:, at : at + 4] == code).all(axis=1)
    if out.any():
        out[out] = (rows[out, at:] == _suffix(rows[out, :at], form1)).all(axis=1)
    return out


def _checked(raw: Column, at: int, form1: bool) -> Column:
    return per_row(raw, "boolean", lambda rows: _agree(rows, at, form1).tolist())


def _made(head: Column, form1: bool) -> Column:
    return per_row(head, "binary", lambda rows: [bytes(s) for s in _suffix(rows, form1)])


def suffix_is_regenerable(raw: Column) -> Column:
    """Whether a raw mode 1 sector's last 288 bytes are what its data gives."""
    return _checked(raw, 2064, False)


def form1_suffix_is_regenerable(raw: Column) -> Column:
    """Whether a raw mode 2 form 1 sector's last 280 bytes are what its data gives."""
    return _checked(raw, 2072, True)


def mode1_suffix(head: Column) -> Column:
    """The last 288 bytes of a raw mode 1 sector from its first 2064."""
    return _made(head, False)


def form1_suffix(head: Column) -> Column:
    """The last 280 bytes of a raw mode 2 form 1 sector from its first 2072."""
    return _made(head, True)


# AES with 128-bit keys in CBC mode without padding (FIPS 197, SP 800-38A), which Spark's aes functions don't offer.


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution box from its rule: the inverse in GF(256) over 0x11B, then an affine map; and its inverse."""
    inverse = np.zeros(256, np.int64)
    power, x = [], 1
    for _ in range(255):
        power.append(x)
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    for k, v in enumerate(power):
        inverse[v] = power[-k % 255]
    turned = [(inverse << k | inverse >> (8 - k)) & 255 for k in range(5)]
    box = np.bitwise_xor.reduce(turned) ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box.astype(np.uint8), back


_BOX, _BACK = _boxes()
#: Byte k of a state is taken from here when rows are shifted; and back.
_SHIFT = np.array([(k + 4 * (k % 4)) % 16 for k in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


def _doubled(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ np.where(x & 0x80, 0x1B, 0).astype(np.uint8)


def _mixed(state: np.ndarray, by: tuple[int, int, int, int]) -> np.ndarray:
    """Columns multiplied by a circulant of small numbers."""
    cells = state.reshape(-1, 4, 4)
    twice = [cells]
    for _ in range(3):
        twice.append(_doubled(twice[-1]))
    times = [np.bitwise_xor.reduce([twice[b] for b in range(4) if m >> b & 1]) for m in by]
    return np.bitwise_xor.reduce([np.roll(t, -k, axis=2) for k, t in enumerate(times)]).reshape(-1, 16)


@lru_cache(maxsize=1024)
def _round_keys(key: bytes) -> np.ndarray:
    words, r = [np.frombuffer(key, np.uint8)[k : k + 4] for k in range(0, 16, 4)], np.uint8(1)
    for k in range(4, 44):
        w = words[-1]
        if k % 4 == 0:
            w = _BOX[np.roll(w, -1)] ^ np.array([r, 0, 0, 0], np.uint8)
            r = _doubled(np.array([r], np.uint8))[0]
        words.append(words[-4] ^ w)
    return np.concatenate(words).reshape(11, 16)


def _encrypted(state: np.ndarray, keys: np.ndarray) -> np.ndarray:
    state = state ^ keys[0]
    for k in range(1, 10):
        state = _mixed(_BOX[state][:, _SHIFT], (2, 3, 1, 1)) ^ keys[k]
    return _BOX[state][:, _SHIFT] ^ keys[10]


def _decrypted(state: np.ndarray, keys: np.ndarray) -> np.ndarray:
    state = _BACK[(state ^ keys[10])[:, _UNSHIFT]]
    for k in range(9, 0, -1):
        state = _BACK[_mixed(state ^ keys[k], (14, 11, 13, 9))[:, _UNSHIFT]]
    return state ^ keys[0]


def _cbc(rows: list[bytes], key: bytes, ivs: list[bytes], decrypt: bool) -> list[bytes]:
    """Rows of one key together: decryption takes all their blocks at a time, encryption the blocks at one place of all rows."""
    if any(len(x) % 16 for x in rows) or len(key) != 16 or any(len(x) != 16 for x in ivs):
        raise ValueError("whole blocks, a key and a start of 16 bytes are needed")
    keys, sizes = _round_keys(key), np.array([len(x) // 16 for x in rows], np.int64)
    blocks = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 16)
    starts = np.cumsum(sizes) - sizes
    before = np.frombuffer(b"".join(ivs), np.uint8).reshape(-1, 16)
    out = np.empty_like(blocks)
    if decrypt:
        chained = np.concatenate((blocks[:1], blocks))[: len(blocks)]
        chained[starts[sizes > 0]] = before[sizes > 0]
        out = _decrypted(blocks, keys) ^ chained
    else:
        before = before.copy()
        for k in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > k)
            before[on] = _encrypted(blocks[starts[on] + k] ^ before[on], keys)
            out[starts[on] + k] = before[on]
    made = out.tobytes()
    return [made[16 * s : 16 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def aes_cbc(data: bytes, key: bytes, iv: bytes, decrypt: bool) -> bytes:
    """data of whole blocks of 16 bytes."""
    return _cbc([data], key, [iv], decrypt)[0]


def aes(data: Column, key: Column, iv: Column, decrypt: bool = True) -> Column:
    """Rows of whole blocks, each with its key and start; null where one of them is."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, k: pd.Series, v: pd.Series) -> pd.Series:
        out: list[bytes | None] = [None] * len(d)
        of: dict[bytes, list[int]] = {}
        for i, (x, y, z) in enumerate(zip(d, k, v, strict=True)):
            if x is not None and y is not None and z is not None:
                of.setdefault(bytes(y), []).append(i)
        for one, at in of.items():
            for i, made in zip(at, _cbc([bytes(d.iat[i]) for i in at], one, [bytes(v.iat[i]) for i in at], decrypt), strict=True):
                out[i] = made
        return pd.Series(out, dtype=object)

    return run(data.cast("binary"), key.cast("binary"), iv.cast("binary"))


def sector_iv(sector: Column) -> Column:
    """The start value of a disc sector that is enciphered by itself: its number as 16 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(sector.cast("long")), 32, "0"))


def derived_key(part: Column, key: Column, iv: Column) -> Column:
    """A disc's key: the 16 bytes that its description holds, enciphered with the key and start of the disc format (parameters; none is kept here)."""
    return aes(part, key, iv, decrypt=False)
