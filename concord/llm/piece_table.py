"""What a worker has learnt about pieces of text: their token ids, by a 64-bit hash of their bytes, in NumPy arrays.

The table is open-addressed and bounded: when `limit` pieces are known, all but the first ones given (the base) are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64


class PieceTable:
    def __init__(self, limit: int):
        self.limit = limit
        self.mask = U((1 << int(2 * limit).bit_length()) - 1)
        self.base: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
        self.reset()

    def reset(self) -> None:
        self.keys, self.numbers = np.zeros(int(self.mask) + 1, U), np.zeros(int(self.mask) + 1, np.int32)
        self.n, self.used = 0, 0
        self.start, self.length, self.flag = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint8)
        self.ids = np.zeros(4096, np.uint32)
        if self.base is not None:
            self.put(*self.base)

    def keep(self) -> None:
        """What is known now is the base."""
        self.base = self.hashes.copy(), self.length[: self.n].copy(), self.ids[: self.used].copy(), self.flag[: self.n].copy()

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't known."""
        at = (h & self.mask).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.numbers[at], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.numbers[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def put(self, h: np.ndarray, length: np.ndarray, ids: np.ndarray, flag: np.ndarray) -> None:
        """Pieces that aren't known: distinct hashes, the numbers of their ids, these one after the other, and a flag of each."""
        n, total = self.n + len(h), self.used + len(ids)
        if n > len(self.start):
            size = max(n, 2 * len(self.start))
            self.start, self.length, self.flag = (np.concatenate([x, np.zeros(size - len(x), x.dtype)]) for x in (self.start, self.length, self.flag))
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, 2 * len(self.ids)) - len(self.ids), np.uint32)])
        self.length[self.n : n], self.flag[self.n : n] = length, flag
        self.start[self.n : n] = self.used + np.cumsum(length) - length
        self.ids[self.used : total] = ids
        numbers = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, total
        at = (h & self.mask).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            free = rest[self.keys[at[rest]] == 0]
            self.keys[at[free]] = h[free]  # of several for one place, the last stays
            placed = free[self.keys[at[free]] == h[free]]
            self.numbers[at[placed]] = numbers[placed]
            gone = np.zeros(len(h), bool)
            gone[placed] = True
            rest = rest[~gone[rest]]
            at[rest] = (at[rest] + 1) & int(self.mask)

    @property
    def hashes(self) -> np.ndarray:
        """The hash of each piece, by number."""
        full = np.flatnonzero(self.keys)
        out = np.zeros(self.n, U)
        out[self.numbers[full]] = self.keys[full]
        return out

    def look_up(self, h: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each piece. learn: (lengths, ids, flags) of the pieces at some places of h; it is asked once for each unknown one."""
        h = np.where(h == 0, U(1), h)
        out = self.find(h)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            new, lead = np.unique(h[lost], return_index=True)
            if self.n + len(new) > self.limit and self.n > (0 if self.base is None else len(self.base[0])):
                self.reset()
                out = self.find(h)
                lost = np.flatnonzero(out < 0)
                new, lead = np.unique(h[lost], return_index=True)
            if self.n + len(new) > self.limit:  # more in one stretch than the table is for
                self.limit = 2 * (self.n + len(new))
                self.mask = U((1 << int(2 * self.limit).bit_length()) - 1)
                self.reset()
                return self.look_up(h, learn)
            self.put(new, *learn(lost[lead]))
            out[lost] = self.find(h[lost])
        return out

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, one after the other, ids of each)."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[numbers] - (ends - length), length)
        return self.ids[at], length


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of the stretches of so many values."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
