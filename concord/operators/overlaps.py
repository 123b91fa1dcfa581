"""Overlaps of texts found in arrays: blocks of texts are met two at a time, and only what overlaps leaves Python.

No row is made for a place or for a pair that shares a gram. A block is all texts of some keys, held as compressed Arrow; each pair of
blocks is one row-pair of a shuffle, so a block is sent (blocks + 1) times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.plans.work import own_session, ship

U = np.uint64
#: Texts and bytes of a block, about; and how many blocks there are at least, so that their pairs are dealt over the cluster.
TEXTS, BYTES, LEAST = 205_000, 22 << 20, 6
#: A block is a row, so batches are short.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: Characters whose places are looked up at once, and pairs that are compared at once, about.
SLICE, PAIRS = 1 << 20, 1 << 19
#: For hashes of grams; and the bits of them that tell most places without a head apart at once.
ODD, BITS = U(0x9E3779B97F4A7C15), 22
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a word


def overlaps(texts: DataFrame, key: str, text: str, gram: int, share: int) -> DataFrame:
    """See `similarity.gram_overlaps`. Texts are counted first, to know the number of blocks."""
    long = texts.filter(F.col(key).isNotNull() & (F.length(text) >= gram)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    n, size = long.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    blocks = max(LEAST, math.ceil(n / TEXTS), math.ceil((size or 0) / BYTES))
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    # All rows of a key are in one block, so what two keys have in common is found by one task.
    packed = long.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_pack, "block int, blob binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = packed.withColumn("o", other).select((F.least("block", "o") * blocks + F.greatest("block", "o")).alias("pair"), "block", "blob")
    met = own_session(met.repartition(blocks * (blocks + 1), "pair").sortWithinPartitions("pair", "block"), BATCH)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None
        for batch in batches:
            for pair, blob in zip(batch.column("pair").to_pylist(), batch.column("blob"), strict=True):
                now = Block(blob.as_buffer(), gram)
                if pair // blocks == pair % blocks:
                    yield from found(now, now, gram, share)
                elif last == pair:
                    yield from found(before, now, gram, share)
                    yield from found(now, before, gram, share)
                    last, before = None, None
                else:
                    last, before = pair, now

    return met.mapInArrow(meet, f"a {kind}, b {kind}, at int, overlap int")


def _pack(table: pa.Table) -> pa.Table:
    """One row: the texts of a block by key, as compressed Arrow."""
    rows = table.select(["k", "t"]).sort_by("k").combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return pa.table({"block": table.column("block").slice(0, 1), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


class Block:
    """keys; code (a number for each row, the same for equal keys, ascending); chars of all texts from end to end, and where each begins; the same as bytes, equal where characters are equal."""

    def __init__(self, blob: pa.Buffer, gram: int):
        rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        self.gram, self.keys = gram, rows.column("k").combine_chunks()
        number = self.keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.code = np.cumsum(np.diff(number, prepend=number[:1]) != 0)
        parts, sizes = [], []
        for k in range(0, rows.num_rows, 10_000):
            held = rows.column("t").slice(k, 10_000).to_pylist()
            chars = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
            parts.append(chars.astype(np.uint8) if chars.max() < 256 else chars)
            sizes += map(len, held)
        chars = np.concatenate([*parts, np.zeros(gram + 8, np.uint8)])
        self.size = np.array(sizes, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.chars = chars
        self.low = chars if chars.dtype == np.uint8 else np.where(chars < 256, chars, chars * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
        self.words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        self.index = None

    def hashes(self, start: int, stop: int) -> np.ndarray:
        """Of the grams that begin at start to stop - 1."""
        out = np.zeros(stop - start, np.uint64)
        for k in range(self.gram):
            out *= ODD
            out += self.low[start + k : stop + k]
        return out

    def heads(self) -> tuple[np.ndarray, ...]:
        """Rows by the hash of their first gram; the different hashes, where each begins and how many rows it has; whether there may be one by its first bits."""
        if self.index is None:
            first = np.zeros(len(self.size), np.uint64)
            for k in range(self.gram):
                first = first * ODD + self.low[self.at[:-1] + k]
            order = np.argsort(first, kind="stable")
            hashes, begin, count = np.unique(first[order], return_index=True, return_counts=True)
            some = np.zeros(1 << BITS, bool)
            some[hashes >> U(64 - BITS)] = True
            self.index = order, hashes, begin, count, some
        return self.index


def _unlike(a: Block, b: Block, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the first n (up to 8) characters at x of a and y of b differ, as far as their bytes tell."""
    end = len(a.words) - 1, len(b.words) - 1
    d = (a.words[np.minimum(x, end[0])] ^ b.words[np.minimum(y, end[1])]) & KEEP[np.clip(n, 0, 8)]
    for k in (4, 2, 1):
        d |= d >> U(k)
    return np.bitwise_count(d & U(0x0101010101010101)).astype(np.int64)


def _alike(a: Block, b: Block, ia: np.ndarray, at: np.ndarray, ib: np.ndarray, share: int) -> tuple[np.ndarray, ...]:
    """ia, at, ib, overlap of the candidates that have the gram and differ in one place of `share` at most."""
    overlap = np.minimum(a.size[ia] - at, b.size[ib])
    x, y, off, done = a.at[ia] + at, b.at[ib], np.zeros(len(ia), np.int64), a.gram
    keep = np.arange(len(ia))
    while len(keep) and done < overlap.max():
        off += _unlike(a, b, x + done, y + done, overlap - done)
        done += 8
        good = off * share <= overlap
        keep, overlap, x, y, off = (v[good] for v in (keep, overlap, x, y, off))
    # What bytes can't tell: grams with the same hash, and characters beyond 255.
    whole = a.gram if a.chars.dtype == b.chars.dtype == np.uint8 else int(overlap.max(initial=0))
    off = np.zeros(len(keep), np.int64) if whole > a.gram else off
    good = np.ones(len(keep), bool)
    for k in range(whole):
        bad = (k < overlap) & (a.chars[np.minimum(x + k, len(a.chars) - 1)] != b.chars[np.minimum(y + k, len(b.chars) - 1)])
        if k < a.gram:
            good &= ~bad
        else:
            off += bad
    good &= off * share <= overlap
    return ia[keep][good], at[keep][good], ib[keep][good], overlap[good]


def found(a: Block, b: Block, gram: int, share: int) -> Iterator[pa.RecordBatch]:
    """a, b, at, overlap of texts of b inside those of a, the longest overlap of each pair of keys, of equal ones the first."""
    order, hashes, begin, count, some = b.heads()
    row = 0
    while row < len(a.size):
        stop = max(row + 1, int(np.searchsorted(a.at, a.at[row] + SLICE, "right")) - 1)
        stop = int(np.searchsorted(a.code, a.code[stop - 1], "right"))  # all rows of a key at once
        hits = []
        for start in range(int(a.at[row]), int(a.at[stop]), SLICE):
            own = a.hashes(start, min(start + SLICE, int(a.at[stop])))
            place = np.flatnonzero(some[own >> U(64 - BITS)])
            to = np.minimum(np.searchsorted(hashes, own[place]), len(hashes) - 1)
            same = hashes[to] == own[place]
            place, to = place[same] + start, to[same]
            ia = np.searchsorted(a.at, place, "right") - 1
            at = place - a.at[ia]
            inside = at <= a.size[ia] - gram
            ia, at, to = ia[inside], at[inside], to[inside]
            total = np.cumsum(count[to])
            k = 0
            while k < len(to):
                until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS, "right")))
                n = count[to[k:until]]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ib = order[np.repeat(begin[to[k:until]], n) + nth]
                ja, jat = np.repeat(ia[k:until], n), np.repeat(at[k:until], n)
                if a is b:
                    other = a.code[ja] != b.code[ib]
                    ja, jat, ib = ja[other], jat[other], ib[other]
                hits.append(_alike(a, b, ja, jat, ib, share))
                k = until
        row = stop
        ia, at, ib, overlap = (np.concatenate(v) for v in zip(*hits, strict=True)) if hits else [np.zeros(0, np.int64)] * 4
        best = np.lexsort((at, -overlap, b.code[ib], a.code[ia]))
        ia, at, ib, overlap = (v[best] for v in (ia, at, ib, overlap))
        pair = a.code[ia] * (len(b.size) + 1) + b.code[ib]
        first = np.flatnonzero(np.diff(pair, prepend=-1) != 0)
        for k in range(0, len(first), PAIRS):
            f = first[k : k + PAIRS]
            yield pa.RecordBatch.from_arrays([a.keys.take(pa.array(ia[f])), b.keys.take(pa.array(ib[f])), pa.array(at[f].astype(np.int32)), pa.array(overlap[f].astype(np.int32))], names=["a", "b", "at", "overlap"])
