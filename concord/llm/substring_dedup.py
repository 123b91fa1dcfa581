"""Substring dedup: repeated windows of words, found by super-k-mer partitioning.

A window is `window` consecutive words of one text. Its minimiser is the least hash of the GRAM-word grams in it, so equal windows
have equal minimisers. Consecutive windows that share a minimiser travel as one packed string of their words (a super-k-mer) to
the bucket of that minimiser, many strings to a compressed blob; there the windows are cut out again, sorted and counted. A
window is compared by two independent 64-bit fingerprints of its words.

A first pass over all texts finds minimisers so frequent that their bucket would not fit a task: every STRIDE-th string of every
task is a sample, whose minimisers are counted over all tasks, so that one that is spread thin is seen as well as one that is
not. The sample decides how windows are counted and never which. Windows of hot minimisers don't travel as strings; they are
counted one by one, summed on the map side first, so that a passage in a third of all texts costs a row a task and window there.
A bucket is read blob by blob, and what is held of a window is its fingerprint and place.

Texts are told apart by 128 bits of their content: identical texts count as often as they are there, have the same repeats, and
get the same result. A word covered by any repeated window is removed; windows are judged on the input.

Defined results: a null or wordless text has no words and keeps the empty text; a text with fewer words than a window keeps all;
repeated rows are repeats of each other; other columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, drop, pieces, text_buffer, text_key
from .words import SEEDS, SPACE, hash_words, mix, split

U = np.uint64
#: Words of a gram, windows of a packed string at most, bytes of a bucket about, bytes packed before blobs are made.
GRAM, LONGEST, BUCKET, HELD = 8, 256, 8 << 20, 32 << 20
#: A minimiser is hot with about an eighth of a bucket's bytes. Of every so many strings one is in the sample that finds them; they
#: are at most HOT_MOST, as beyond that number each must have a larger share.
STRIDE, HOT_MOST = 64, 1 << 22
#: Bytes of packed strings that are cut into words at once, and parts that rows of one hot window go to.
PART, SALTS = 4 << 20, 16


def rolling(h: np.ndarray, width: int, seed: np.uint64) -> np.ndarray:
    """A hash of the `width` entries from each place on (zeros past the end), by doubling."""
    out, at, power = np.zeros(len(h), U), 0, 1  # power: seed to the at
    level, size, its = h, 1, int(seed)
    while width:
        if width & 1:
            out = out + U(power) * np.concatenate([level[at:], np.zeros(min(at, len(h)), U)])
            at, power = at + size, power * its % 2**64
        width >>= 1
        if width:
            level = level + U(its) * np.concatenate([level[size:], np.zeros(min(size, len(h)), U)])
            size, its = 2 * size, its * its % 2**64
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on; short of the end, of those there are."""
    size, top = 1, U(2**64 - 1)
    while 2 * size <= width:
        x = np.minimum(x, np.concatenate([x[size:], np.full(min(size, len(x)), top)]))
        size *= 2
    if size < width:
        x = np.minimum(x, np.concatenate([x[width - size :], np.full(min(width - size, len(x)), top)]))
    return x


class Texts:
    """Words of some texts, each of which ends in white space, and their super-k-mers."""

    def __init__(self, column: pa.Array, window: int):
        data, at = text_buffer(column)
        self.starts, self.ends, self.first = split(data, at)
        self.words = np.diff(self.first)
        keep = ~SPACE[data]
        keep[1:] |= keep[:-1] & SPACE[data[1:]]
        self.normal = data[keep]
        self.normal[SPACE[self.normal]] = 0x20
        self.place = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        self.data, self.window = data, window

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix(rolling(hash_words(self.data, self.starts, self.ends, k), self.window, seed | U(1))) for k, seed in enumerate(SEEDS))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, windows, minimiser) of each super-k-mer; windows are numbered as the words they begin with."""
        gram = min(GRAM, self.window)
        grams = mix(rolling(hash_words(self.data, self.starts, self.ends), gram, SEEDS[1] | U(1)))
        least = sliding_least(grams, self.window - gram + 1)
        text = np.repeat(np.arange(len(self.words)), self.words)
        begin = np.flatnonzero(np.arange(len(text)) + self.window <= self.first[1:][text])
        if not len(begin):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
        value = least[begin]
        new = np.concatenate([[True], (np.diff(begin) != 1) | (value[1:] != value[:-1])])
        lead = np.flatnonzero(new)
        offset = np.arange(len(begin)) - np.repeat(lead, np.diff(np.append(lead, len(begin))))
        lead = np.flatnonzero(offset % LONGEST == 0)
        return text[begin[lead]], begin[lead], np.diff(np.append(lead, len(begin))), value[lead]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    k1, k2 = text_key(F.col(text))
    return docs.select(k1, k2, F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" ")).alias("text"))


def frequent_minimisers(docs: DataFrame, text: str, window: int) -> tuple[np.ndarray, int]:
    """(minimisers that are hot, sorted; number of buckets), from all texts. What reaches the driver is at most HOT_MOST numbers."""
    docs, stride = bounded(docs), STRIDE

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each task begins at another string, so that short ones together are a fair sample too.
        seen, packed = int(mix(np.array([TaskContext.get().partitionId() + 1], U))[0] % U(stride)), 0
        for batch in batches:
            for some in pieces(batch, "text"):
                texts = Texts(some.column("text"), window)
                _, begin, windows, value = texts.runs()
                packed += int((texts.place[begin + windows + window - 1] - texts.place[begin]).sum())
                picked = value[-seen % stride :: stride].view(np.int64)
                seen += len(value)
                yield pa.RecordBatch.from_arrays([pa.array(picked), pa.array(np.zeros(len(picked), np.int64))], ["value", "packed"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([packed], pa.int64())], ["value", "packed"])

    counts = _keyed(docs, text).select("text").mapInArrow(sample, "value long, packed long").groupBy("value").agg(F.count("*").alias("n"), F.sum("packed").alias("packed"))
    found = cut(counts, "minimisers")
    sums = found.agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n"), F.sum("packed").alias("packed")).first()
    packed, strings = sums.packed or 0, sums.n or 0
    # Half the strings that an eighth of a bucket has, to be sure of those that have as many.
    least = max(2.0, BUCKET / 16 * strings / max(1, packed), strings / HOT_MOST)
    hot = found.filter(F.col("value").isNotNull() & (F.col("n") >= least)).select("value").toArrow().column("value").to_numpy()
    drop(found)
    return np.sort(hot.view(U)), max(32, -(-packed // BUCKET))


def is_hot(value: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted hot ones."""
    return hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value if len(hot) else np.zeros(len(value), bool)


def spread(docs: DataFrame, text: str, window: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """bucket, blob: the super-k-mers of all minimisers that aren't hot."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, held, size = zstandard.ZstdCompressor(level=3), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not any(len(h[0]) for h in held):
                return
            bucket, k1, k2, start, windows = (np.concatenate([h[i] for h in held]) for i in range(5))
            strings = [s for h in held for s in h[5]]
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)) + 1
            names, blobs, begin = [], [], 0
            for end in ends.tolist():
                at = order[begin:end]
                own = [strings[i] for i in at.tolist()]
                head = [np.array([end - begin], "<i8"), k1[at], k2[at], start[at], windows[at], np.fromiter(map(len, own), np.int64, len(own))]
                blobs.append(squeeze.compress(b"".join([*(np.ascontiguousarray(x).tobytes() for x in head), *own])))
                names.append(int(bucket[at[0]]))
                begin = end
            held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for some in pieces(batch, "text"):
                texts = Texts(some.column("text"), window)
                doc, begin, windows, value = texts.runs()
                cold = np.flatnonzero(~is_hot(value, shared.value))
                doc, begin, windows, value = doc[cold], begin[cold], windows[cold], value[cold]
                a, b = texts.place[begin], texts.place[begin + windows + window - 1]
                view = memoryview(texts.normal)
                strings = [view[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                k1, k2 = (some.column(c).to_numpy()[doc] for c in ("k1", "k2"))
                held.append(((mix(value) % U(buckets)).astype(np.int64), k1, k2, begin - texts.first[doc], windows, strings))
                size += int((b - a).sum())
                if size > HELD:
                    yield from flush()
        yield from flush()

    return _keyed(docs, text).mapInArrow(pack, "bucket int, blob binary")


def unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    """(k1, k2, start, windows and bytes of each string as rows, the strings) of a blob."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i8", 5 * n, 8).reshape(5, n), raw[8 + 40 * n :]


def parts_of(blobs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """The strings of some blobs, about PART bytes at a time."""
    heads, raws, size = [], [], 0
    for head, raw in map(unpacked, blobs):
        heads.append(head), raws.append(raw)
        size += len(raw)
        if size >= PART:
            yield np.concatenate(heads, axis=1), b"".join(raws)
            heads, raws, size = [], [], 0
    if heads:
        yield np.concatenate(heads, axis=1), b"".join(raws)


def count_bucket(blobs: Iterable[bytes], window: int) -> pa.Table:
    """k1, k2, start, end (words) of the stretches that repeated windows of a bucket cover, each once."""
    heads, prints, runs, offsets, n = [], [], [], [], 0
    for head, raw in parts_of(blobs):
        windows, sizes = head[3], head[4]
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        texts = Texts(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(raw)), window)
        run = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = texts.first[:-1][run] + offset
        prints.append(np.stack([f[place] for f in texts.fingerprints()]))
        runs.append((run + n).astype(np.int32)), offsets.append(offset.astype(np.int16))
        heads.append(head[:3].copy())
        n += len(windows)
    (f1, f2), run, offset = np.concatenate(prints, axis=1), np.concatenate(runs), np.concatenate(offsets)
    k1, k2, start = np.concatenate(heads, axis=1)
    del prints, runs, offsets, heads
    order = np.argsort(f1)
    equal, same = f1[order[1:]] == f1[order[:-1]], f2[order[1:]] == f2[order[:-1]]
    if (equal & ~same).any():  # two windows with one first fingerprint: copies need not be neighbours
        order = np.lexsort((f2, f1))
        equal, same = f1[order[1:]] == f1[order[:-1]], f2[order[1:]] == f2[order[:-1]]
    same &= equal
    repeated = np.zeros(len(order), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    found = np.flatnonzero(repeated)
    new = np.concatenate([[True], (np.diff(found) != 1) | (np.diff(run[found]) != 0)])[: len(found)]
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(found)) - 1 if len(lead) else lead
    own = run[found[lead]]
    rows = pa.table({"k1": k1[own], "k2": k2[own], "start": start[own] + offset[found[lead]], "end": start[own] + offset[found[last]] + window})
    return rows.group_by(["k1", "k2", "start", "end"]).aggregate([])


def hot_stretches(docs: DataFrame, text: str, window: int, hot: np.ndarray) -> DataFrame:
    """k1, k2, start, end of the repeated windows of hot minimisers."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text", 1 << 20):
                doc, _, _, value = Texts(some.column("text"), window).runs()
                some = some.take(pa.array(np.unique(doc[is_hot(value, shared.value)])))
                texts = Texts(some.column("text"), window)
                doc, begin, windows, value = texts.runs()
                those = np.flatnonzero(is_hot(value, shared.value))
                doc, begin, windows = doc[those], begin[those], windows[those]
                place = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
                of = np.repeat(doc, windows)
                f1, f2 = texts.fingerprints()
                yield pa.RecordBatch.from_arrays([pa.array(f1[place].view(np.int64)), pa.array(f2[place].view(np.int64)), *(pa.array(some.column(c).to_numpy()[of]) for c in ("k1", "k2")), pa.array(place - texts.first[of])], ["f1", "f2", "k1", "k2", "start"])

    kinds = "f1 long, f2 long, k1 long, k2 long, start long"
    # Copies of a text are one row with a count from here on.
    rows = cut(_keyed(docs, text).mapInArrow(cut_out, kinds).groupBy("f1", "f2", "k1", "k2", "start").agg(F.count("*").alias("n")), "hot-windows")
    often = cut(rows.groupBy("f1", "f2").agg(F.sum("n").alias("n")).filter("n > 1").select("f1", "f2"), "hot-repeats")
    # Many texts may have one window: their rows are dealt out by a part of the text's key as well.
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(often, ["f1", "f2", "salt"]).select("k1", "k2", "start", (F.col("start") + window).alias("end"))


def repeated_stretches(docs: DataFrame, *, text: str = "text", window: int = 35) -> DataFrame:
    """k1, k2 (of a text), spans (array of start, end in words): what repeated windows cover in each text that has any."""
    hot, buckets = frequent_minimisers(docs, text, window)

    def count(table: pa.Table) -> pa.Table:
        return count_bucket(table.column("blob").to_pylist(), window)

    found = spread(docs, text, window, hot, buckets).groupBy("bucket").applyInArrow(count, "k1 long, k2 long, start long, end long")
    if len(hot):
        found = found.union(hot_stretches(docs, text, window, hot))
    return cut(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, *, text: str = "text", window: int = 35, as_it_was: bool = False) -> DataFrame:
    """row (a struct of all other columns), n_words, n_removed, kept (the words that stay, joined by one space) of each row. as_it_was: a text that loses nothing is kept as it came."""
    docs = bounded(docs)
    spans = repeated_stretches(docs, text=text, window=window)
    rest = [c for c in docs.columns if c != text]
    k1, k2 = text_key(F.col(text))
    rows = docs.select(k1, k2, F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("_")])).alias("row"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" ")).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    joined = rows.join(spans, ["k1", "k2"], "left").select("row", "text", F.col("spans.start").alias("a"), F.col("spans.end").alias("b"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                texts = Texts(some.column("text"), window)
                change = np.zeros(len(texts.starts) + 1, np.int64)
                for name, by in (("a", 1), ("b", -1)):
                    column = some.column(name)
                    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
                    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
                    values = column.flatten().to_numpy()
                    np.add.at(change, np.repeat(texts.first[:-1], sizes) + values, by)
                stays = np.cumsum(change)[:-1] <= 0
                size = np.diff(texts.place)
                kept = texts.normal[np.repeat(stays, size)]
                count = np.concatenate([[0], np.cumsum(stays)])[texts.first]
                ends = np.concatenate([[0], np.cumsum(np.where(stays, size, 0))])[texts.first]
                raw, ends = memoryview(np.ascontiguousarray(kept)), ends.tolist()
                out = [bytes(raw[x : max(x, y - 1)]).decode() for x, y in zip(ends, ends[1:], strict=False)]
                if as_it_was:
                    whole = np.flatnonzero(np.diff(count) == texts.words)
                    for i, t in zip(whole.tolist(), some.column("text").take(pa.array(whole)).to_pylist(), strict=True):
                        out[i] = t[:-1]
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(texts.words, pa.int64()), pa.array(texts.words - np.diff(count), pa.int64()), pa.array(out, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(remove, f"row {kind}, n_words long, n_removed long, kept string")
