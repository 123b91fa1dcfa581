"""Words of Arrow text buffers as NumPy arrays: where they are, and 64-bit hashes of them."""

from __future__ import annotations

import numpy as np

#: The delimiters of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
#: Odd multipliers of the two hash streams, from the fractional bits of square roots.
SEEDS = (U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and for each text (and one past the last) the number of its first word. A word never goes over the end of a text."""
    space = SPACE[data]
    word = ~space
    opens, closes = word.copy(), word.copy()
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= word[inner]
    closes[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    out = mix(length.astype(U) * SEEDS[stream])
    rest, begin, left = None, starts, length
    while True:
        block = loads[begin] & _MASKS[np.minimum(left, 8)]
        if rest is None:
            out = mix((out ^ block) * SEEDS[stream])
        else:
            out[rest] = mix((out[rest] ^ block) * SEEDS[stream])
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rest = more if rest is None else rest[more]
        begin, left = begin[more] + 8, left[more] - 8
