"""The lagged Fibonacci generator that fills unused parts of some discs, and the way back from its bytes to its seed.

Seventeen words are the seed. They are expanded to LONG words, squeezed (two bits of each are lost), and from there on
every word is the exclusive or of the words LONG and SHORT places before it; the first ROUNDS * LONG of these are left
out. Words are big-endian. Since a word depends on none closer than SHORT places, SHORT words are made at a time, and
a whole table of seeds at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

# Fixed values of the generator.
LONG = 521
SHORT = 32
SEED_WORDS = 17
ROUNDS = 4

SEED_BYTES = 4 * SEED_WORDS
#: Bytes that hold LONG whole words wherever they start.
ENOUGH = 4 * LONG + 3


def _expanded(seeds: np.ndarray) -> np.ndarray:
    """LONG words from each row of SEED_WORDS words."""
    x = np.zeros((len(seeds), LONG), np.uint32)
    x[:, :SEED_WORDS] = seeds
    for n in range(SEED_WORDS, LONG):
        x[:, n] = x[:, n - 17] << 23 ^ x[:, n - 16] >> 9 ^ x[:, n - 1]
    return x


def _squeezed(x: np.ndarray) -> np.ndarray:
    """The third byte is taken from two bits further up: bits 16 and 17 are lost, bits 24 and 25 stand twice."""
    return x & 0xFF00FFFF | x >> 2 & 0x00FF0000


def _continued(state: np.ndarray, n: int) -> np.ndarray:
    """n words that follow a state of LONG words, row by row."""
    x = np.empty((len(state), LONG + n + SHORT), np.uint32)
    x[:, :LONG] = state
    for at in range(LONG, LONG + n, SHORT):
        x[:, at : at + SHORT] = x[:, at - LONG : at - LONG + SHORT] ^ x[:, at - SHORT : at]
    return x[:, LONG : LONG + n]


def _rewound(state: np.ndarray, n: int) -> np.ndarray:
    """The state of LONG words n words earlier: word m was the exclusive or of words m + LONG and m + LONG - SHORT."""
    x = np.empty((len(state), n + LONG), np.uint32)
    x[:, n:] = state
    for stop in range(n, 0, -SHORT):
        at = max(stop - SHORT, 0)
        x[:, at:stop] = x[:, at + LONG : stop + LONG] ^ x[:, at + LONG - SHORT : stop + LONG - SHORT]
    return x[:, :LONG]


def stream(seed: bytes, at: int, size: int) -> bytes:
    """size bytes of what a seed of SEED_BYTES bytes gives, from byte `at` on."""
    if len(seed) != SEED_BYTES or at < 0 or size < 0:
        raise ValueError(f"a seed of {SEED_BYTES} bytes and a place in its stream are needed")
    start = _squeezed(_expanded(np.frombuffer(seed, ">u4").astype(np.uint32)[None]))
    left_out = (ROUNDS - 1) * LONG
    made = _continued(start, left_out + -(-(at + size) // 4))[0, left_out:]
    return made.astype(">u4").tobytes()[at : at + size]


def seed_of(data: bytes, at: int = 0) -> bytes | None:
    """The seed whose stream holds data from byte `at` on, or None. LONG whole words of it are needed.

    The two bits that the squeeze lost are found in later words: nine places down they are part of the word 16 places on, where the
    only other term is the word before that one. Those of the first word are part of none: the same rule
    fills them, and whatever they were, the stream is the same.
    """
    skip = -at % 4
    words = np.frombuffer(data, ">u4", (len(data) - skip) // 4, skip).astype(np.uint32) if len(data) >= skip + 4 * LONG else np.empty(0, np.uint32)
    if len(words) < LONG:
        return None
    x = _rewound(words[None, :LONG], ROUNDS * LONG + (at + skip) // 4)[0]
    if ((x >> 22 ^ x >> 24) & 3).any():
        return None
    lost = (x[16 : 16 + SEED_WORDS] ^ x[15 : 15 + SEED_WORDS]) >> 7 & 3
    kept = x[:SEED_WORDS]
    # Bits 18 to 25 stand in bits 16 to 23.
    seed = (kept & 0xFF00FFFF | kept << 2 & 0x00FC0000 | lost << 16).astype(">u4").tobytes()
    return seed if stream(seed, at, len(data)) == data else None


@lru_cache(maxsize=32)
def _whole(seed: bytes, period: int) -> bytes:
    """A block's stream, remembered for its other sectors."""
    return stream(seed, 0, period)


def repeating(period: int) -> Callable[[bytes, int, int], bytes]:
    """A generator of (seed, first byte, size) for discs whose blocks of `period` bytes each have a seed: the stream starts anew at each."""

    def generator(seed: bytes, at: int, size: int) -> bytes:
        if at % period + size > period:
            raise ValueError("a sector reaches over the end of its block")
        return _whole(bytes(seed), period)[at % period : at % period + size]

    return generator
