"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions. Every context of the last 0 to DEPTH bytes keeps, for each of the 255 places in the tree of
decisions, how often 0 and 1 followed, and estimates them as Krichevsky and Trofimov do; context-tree weighting mixes the
estimates of all depths, each node weighing its own estimate against that of its children by how well either codes all
training text. The counts come from all bytes of all training texts, each text ended by a byte that no text has, and every
context that occurs is a node: the model grows with the corpus. A text's score is the log10 probability of its bytes, after
lower-casing A-Z, and of its end.

Nothing holds the whole tree. Contexts are spread by their last SPLIT bytes; under one of those are at most 256^(DEPTH-SPLIT+1)
counts, and a task works through them one after the other. The levels above are sums of rows. Going up, each level adds the
weighted log probabilities of its children; going down, each passes on the mixture so far and the weight that is left. So every
distinct gram (a context and a byte) of all texts, trained on or not, gets its log probability. Texts are scored by adding up:
the FREQUENT most frequent grams and the COMMON most frequent words are broadcast (12 bytes each), all others are joined.

The unigram base line is exact: the counts of all words.

Defined results: what precedes a text is as zero bytes; where training lacks a context, the longest one it has decides with all
the weight that is left; a null or empty text has one token, the end, and the score of an end; without training texts every bit
has probability 1/2; a row without an id is not trained on and is not held out; repeated rows count each; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, cut_small, pieces, text_buffer
from .crf_language import held_out as _held_out
from .words import LOWER, hash_words, mix, split

U = np.uint64
#: Bytes of the longest context (6 at most), and of those by which contexts are spread.
DEPTH, SPLIT = 5, 3
#: Grams and words that are broadcast at most.
FREQUENT, COMMON = 1 << 20, 1 << 19
#: Entries that a counting task holds before it merges them, and rows that a task works through at once.
HELD, ROWS = 1 << 20, 1 << 16
#: Fixed value: a byte that UTF-8 doesn't have.
END = 0xFF


def held_out(doc_id: str) -> Column:
    return _held_out(doc_id, 7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers: Stirling's series, after moving them to 8 or more."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (small := x < 8).any():
        shift[small] -= np.log(x[small])
        x[small] += 1
    inverse = 1 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


#: The logarithms of gamma at the first halves and integers: n + 1/2 and n + 1.
_HALF, _WHOLE = log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(4096) + 1.0)


def _looked_up(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    far = np.flatnonzero(n >= len(table))
    out[far] = log_gamma(n[far] + more)
    return out


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that the Krichevsky-Trofimov estimate gives to so many zeros and ones."""
    zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    return _looked_up(zeros, _HALF, 0.5) + _looked_up(ones, _HALF, 0.5) - np.log(np.pi) - _looked_up(zeros + ones, _WHOLE, 1.0)


def weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted log probability, own share) of nodes with these counts, whose children have `below` together."""
    own = kt_log(zeros, ones)
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Level:
    """The nodes of the contexts of one depth, from sorted distinct grams (context and byte as one number) and their counts.

    code: context and place (1 to 255: a one, then the bits decided before); z, o; of: the node of each of a gram's eight decisions.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        code, z, o, self.of, base = [], [], [], [], 0
        for d in range(8):
            place = keys >> (8 - d)
            new = np.concatenate([[True], place[1:] != place[:-1]])[: len(keys)]
            lead = np.flatnonzero(new)
            one = np.add.reduceat(np.where(keys >> (7 - d) & 1, n, 0), lead) if len(lead) else n[:0]
            every = np.add.reduceat(n, lead) if len(lead) else n[:0]
            code.append(((place[lead] >> d) << 8) | (1 << d) | (place[lead] & ((1 << d) - 1)))
            z.append(every - one), o.append(one)
            self.of.append(np.cumsum(new) - 1 + base)
            base += len(lead)
        self.code, self.z, self.o = map(np.concatenate, (code, z, o))
        self.estimate = (self.o + 0.5) / (self.z + self.o + 1)

    def shorter(self) -> Level:
        """The level of contexts that are one byte shorter."""
        keys = ((self.keys >> 16) << 8) | (self.keys & 255)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], self.n[order]
        lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        return Level(keys[lead], np.add.reduceat(n, lead) if len(lead) else n)

    def parents(self, above: Level) -> np.ndarray:
        """The node of the level above that each node is under."""
        order = np.argsort(above.code)
        return order[np.searchsorted(above.code[order], ((self.code >> 16) << 8) | (self.code & 255))]


def climb(keys: np.ndarray, n: np.ndarray, levels: int) -> tuple[list[Level], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(levels from the deepest up, weighted log probabilities, own shares, and each but the last one's parents)."""
    found = [Level(keys, n)]
    logs, shares, parents = [kt_log(found[0].z, found[0].o)], [np.ones(len(found[0].z))], []
    for _ in range(levels - 1):
        up = found[-1].shorter()
        parents.append(found[-1].parents(up))
        log, share = weighed(up.z, up.o, np.bincount(parents[-1], logs[-1], len(up.z)))
        found.append(up), logs.append(log), shares.append(share)
    return found, logs, shares, parents


def passed_on(above, left, share, estimate, seen):
    """(mixture so far, weight left) of a child, from its parent's: a child that training hasn't seen takes what its parent ends with."""
    return np.where(seen, above + left * share * estimate, above + left * estimate), np.where(seen, left * (1 - share), 0.0)


def descend(keys: np.ndarray, n: np.ndarray, levels: int, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The log10 probability of each gram. state: code, mixture so far and weight left of the topmost level's nodes."""
    found, _, shares, parents = climb(keys, n, levels)
    order = np.argsort(state[0])
    at = order[np.searchsorted(state[0][order], found[-1].code)]
    above, left = state[1][at], state[2][at]
    for k in range(levels - 1, 0, -1):
        up, down, of = found[k], found[k - 1], parents[k - 1]
        above, left = passed_on(above[of], left[of], shares[k][of], up.estimate[of], down.z + down.o > 0)
    one = np.clip(above + left * found[0].estimate, 1e-12, 1 - 1e-12)
    out = np.zeros(len(keys))
    for d, of in enumerate(found[0].of):
        out += np.log10(np.where(keys >> (7 - d) & 1, one[of], 1 - one[of]))
    return out


def coded(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts, one for each byte and end; where each text's begin). A gram is a byte (lowest) and the `depth` bytes before it, the last highest."""
    sizes = np.diff(at) + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.insert(data, at[1:], END)
    place = np.arange(len(symbols)) + np.repeat(depth * np.arange(1, len(sizes) + 1), sizes)
    padded = np.zeros(len(symbols) + depth * len(sizes), np.uint8)
    padded[place] = symbols
    code = symbols.astype(np.int64)
    for k in range(1, depth + 1):
        code |= padded[place - k].astype(np.int64) << (8 * (depth + 1 - k))
    return code, first


class Sums:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self):
        self.keys, self.n, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.waiting.append((keys[lead], np.diff(np.append(lead, len(keys)))))
        self.size += len(lead)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        n = np.concatenate([self.n, *(n for _, n in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = keys[lead], np.add.reduceat(n, lead) if len(lead) else n
        self.waiting, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        got = self.keys, self.n
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return got


def counted(texts: DataFrame, depth: int) -> DataFrame:
    """kind (0: word, 1: gram, 2: texts), key, n (in training texts), m (in all) over all rows of texts (train, text). Words are those of training texts."""

    def rows(kind: int, keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(m)], ["kind", "key", "n", "m"])

    def sent(kind: int, sums: Sums) -> pa.RecordBatch:
        keys, n = sums.take()
        return rows(min(kind, 1), keys, n if kind < 2 else np.zeros_like(n), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [Sums(), Sums(), Sums()], 0  # words; grams of training texts; of the others
        for batch in batches:
            for some in pieces(batch, "text"):
                train = some.column("train").to_numpy(zero_copy_only=False)
                n += int(train.sum())
                for own, is_train in ((some.filter(pa.array(train)), True), (some.filter(pa.array(~train)), False)):
                    data, at = text_buffer(own.column("text"))
                    data = LOWER[data]
                    held[1 if is_train else 2].add(coded(data, at, depth)[0])
                    if is_train:
                        starts, ends, _ = split(data, at)
                        held[0].add(hash_words(data, starts, ends).view(np.int64))
            for kind, sums in enumerate(held):
                if len(sums.keys) > HELD:  # more than a task should hold; Spark sums up what is sent twice
                    yield sent(kind, sums)
        for kind, sums in enumerate(held):
            yield sent(kind, sums)
        yield rows(2, np.zeros(1, np.int64), np.array([n]), np.array([n]))

    return texts.mapInArrow(run, "kind int, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, size: int = ROWS) -> Iterator[pa.Table]:
    """Sorted batches as tables of about so many rows that don't cut a group of equal values."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        values = batch.column(column).to_numpy()
        if n < size or values[0] == values[-1] and held[0].column(column)[0].as_py() == values[-1]:
            continue
        table = pa.Table.from_batches(held)
        cut_at = int(np.searchsorted(table.column(column).to_numpy(), values[-1], "left"))
        if cut_at:
            yield table.slice(0, cut_at)
            held = table.slice(cut_at).combine_chunks().to_batches()
            n = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def gram_logs(grams: DataFrame, depth: int, split_at: int = SPLIT) -> DataFrame:
    """key, m, log (log10 probability) of each gram of grams (key, n, m)."""
    top = min(split_at, depth)
    levels, down_by = depth - top + 1, 8 * (depth + 1 - top)
    grams = bounded(grams, ROWS // 4, 16 << 20).withColumn("c", F.shiftright("key", down_by))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "c"):
            found, logs, _, _ = climb(table.column("key").to_numpy(), table.column("n").to_numpy(), levels)
            code = found[-1].code
            yield pa.RecordBatch.from_arrays([pa.array(code >> 8), pa.array((code & 255).astype(np.int32)), pa.array(found[-1].z), pa.array(found[-1].o), pa.array(logs[-1])], ["c", "place", "z", "o", "log"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            log, share = weighed(*(b.column(x).to_numpy() for x in ("z", "o", "below")))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("c", "place", "z", "o")), pa.array(log), pa.array(share)], ["c", "place", "z", "o", "log", "share"])

    nodes = cut(grams.select("c", "key", "n").repartition("c").sortWithinPartitions("c", "key").mapInArrow(up, "c long, place int, z long, o long, log double"), "nodes")
    above: list[DataFrame] = []
    for _ in range(top):
        sums = (above[-1] if above else nodes).groupBy(F.shiftright("c", 8).alias("c"), "place").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("log").alias("below"))
        above.append(cut_small(sums.mapInArrow(weigh, "c long, place int, z long, o long, log double, share double"), "nodes"))
    # From the root down to the level that is spread. A node that training hasn't seen takes what its parent ends with.
    state = above.pop().withColumn("above", F.lit(0.0)).withColumn("left", F.lit(1.0))
    for level in [*reversed(above), nodes]:
        estimate = (F.col("p_o") + 0.5) / (F.col("p_z") + F.col("p_o") + 1)
        seen = F.col("z") + F.col("o") > 0
        parent = state.select(F.col("c").alias("p"), "place", F.col("z").alias("p_z"), F.col("o").alias("p_o"), F.col("share").alias("p_share"), F.col("above").alias("p_above"), F.col("left").alias("p_left"))
        own = F.when(seen, F.col("p_left") * F.col("p_share") * estimate).otherwise(F.col("p_left") * estimate)
        left = F.when(seen, F.col("p_left") * (1 - F.col("p_share"))).otherwise(0.0)
        state = cut_small(level.withColumn("p", F.shiftright("c", 8)).join(parent, ["p", "place"]).select(*level.columns, (F.col("p_above") + own).alias("above"), left.alias("left")), "state")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "c"):
            is_gram = table.column("gram").to_numpy()
            key, n, m, a, b, c = (table.column(x).to_numpy() for x in ("key", "n", "m", "above", "left", "c"))
            node = ~is_gram
            log = descend(key[is_gram], n[is_gram], levels, ((c[node] << 8) | key[node], a[node], b[node]))
            yield pa.RecordBatch.from_arrays([pa.array(key[is_gram]), pa.array(m[is_gram]), pa.array(log.astype(np.float32))], ["key", "m", "log"])

    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    both = grams.select("c", F.lit(True).alias("gram"), "key", "n", "m", none.alias("above"), none.alias("left"))
    both = both.union(state.select("c", F.lit(False), F.col("place").cast("long"), zero, zero, "above", "left"))
    return cut(both.repartition("c").sortWithinPartitions("c", "gram", "key").mapInArrow(down, "key long, m long, log float"), "gram-logs")


class Known:
    """Numbers by key, as an open-addressed table that is made where it is first used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.places = keys, values, None

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.__init__(*state)

    def make(self) -> None:
        size = 1 << max(4, int(3 * len(self.keys)).bit_length())
        self.mask = size - 1
        self.places = np.full(size, -1, np.int32)
        at, rest = self.slot(self.keys), np.arange(len(self.keys))
        while len(rest):
            free = rest[self.places[at[rest]] < 0]
            self.places[at[free]] = free  # of several for one place, the last stays
            rest = rest[self.places[at[rest]] != rest]
            at[rest] = (at[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(U)) & U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't there."""
        if self.places is None:
            self.make()
        at = self.slot(keys)
        out = self.places[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = now = self.places[at[open_]]
            open_ = open_[(now >= 0) & (self.keys[np.maximum(now, 0)] != keys[open_])]
        return out


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most so many, by classes of counts of nearly the same size. What reaches the driver is one row a class."""
    size = F.floor(F.log2(count) * 8)
    classes = sorted(rows.groupBy(size.alias("size")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.size)
    total, least = 0, None
    for r in classes:
        if total + r.k > most:
            break
        total, least = total + r.k, r.size
    return rows.filter(size >= least) if least is not None else rows.limit(0)


def known(rows: DataFrame, key: str, value: str) -> Known:
    got = rows.select(key, value).toArrow()
    return Known(got.column(key).to_numpy(), got.column(value).to_numpy())


def sought(table: Known, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sum of values, keys found) of each stretch, and its other keys: where each stretch's begin, each once, and how often."""
    at = table.find(keys)
    found = at >= 0
    value = np.where(found, table.values[at] if len(table.values) else 0.0, 0.0)
    total, sure = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)]), np.concatenate([[0], np.cumsum(found)])
    lost = np.flatnonzero(~found)
    rest, of = keys[lost], np.searchsorted(first, lost, "right") - 1
    by = np.lexsort((rest, of))
    rest, of = rest[by], of[by]
    lead = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (of[1:] != of[:-1])])) if len(rest) else np.zeros(0, np.int64)
    lists = np.searchsorted(of[lead], np.arange(len(first)))
    return np.diff(total[first]), np.diff(sure[first]), lists, rest[lead], np.diff(np.append(lead, len(rest)))


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row, learnt from the rows that aren't held out."""
    if not 1 <= depth <= 6:
        raise ValueError("contexts of 1 to 6 bytes")
    docs = bounded(docs)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    counts = cut(counted(keyed.select((F.col("doc_id").isNotNull() & ~F.col("held_out")).alias("train"), "text"), depth), "counts")
    words = counts.filter("kind = 0").select("key", F.col("n").alias("c"), F.log10(F.col("n") + F.lit(1.0)).alias("log"))
    row = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    texts = counts.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    total, distinct = (row.n or 0) + texts, row.v + (texts > 0)
    least = float(np.log10(total + distinct + 1))
    grams = gram_logs(counts.filter("kind = 1").select("key", "n", "m"), depth)
    shared = docs.sparkSession.sparkContext.broadcast((known(most_frequent(words, "c", common), "key", "log"), known(most_frequent(grams, "m", frequent), "key", "log")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_grams = shared.value
        for batch in batches:
            for some in pieces(batch, "text", 1 << 20):
                data, at = text_buffer(some.column("text"))
                data = LOWER[data]
                starts, ends, first = split(data, at)
                codes, begin = coded(data, at, depth)
                logs, sure, w_lists, w_rest, w_times = sought(of_words, hash_words(data, starts, ends).view(np.int64), first)
                own, _, g_lists, g_rest, g_times = sought(of_grams, codes, begin)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("held_out"), pa.array(np.diff(first) + 1, pa.int64()), pa.array(sure, pa.int64()), pa.array(logs), pa.array(own), pa.array(np.diff(at), pa.int64())]
                    + [pa.ListArray.from_arrays(x.astype(np.int32), pa.array(y)) for x, y in ((w_lists, w_rest), (w_lists, w_times.astype(np.int32)), (g_lists, g_rest), (g_lists, g_times.astype(np.int32)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "words", "w_times", "grams", "g_times"],
                )

    table = keyed.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, words array<long>, w_times array<int>, grams array<long>, g_times array<int>")
    table = cut(table.withColumn("rid", F.monotonically_increasing_id()), "scores")
    # What wasn't broadcast. Only words that training has can add to a base score; those without are 0 in both sums.
    is_gram = [table.select("rid", F.lit(g).alias("gram"), F.explode(F.arrays_zip(F.col(k).alias("key"), F.col(t).alias("times"))).alias("x")).select("rid", "gram", "x.key", "x.times") for g, k, t in ((False, "words", "w_times"), (True, "grams", "g_times"))]
    logs = words.select(F.lit(False).alias("gram"), "key", "log").union(grams.select(F.lit(True), "key", F.col("log").cast("double")))
    rest = is_gram[0].union(is_gram[1]).join(logs, ["gram", "key"])
    word = ~F.col("gram")
    rest = rest.groupBy("rid").agg(F.sum(F.when(word, F.col("times"))).alias("more"), F.sum(F.when(word, F.col("times") * F.col("log"))).alias("more_logs"), F.sum(F.when(F.col("gram"), F.col("times") * F.col("log"))).alias("more_score"))
    full = table.drop("words", "w_times", "grams", "g_times").join(cut(rest, "rare"), "rid", "left")
    end_log = float(np.log10(texts + 1.0))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end_log - F.col("n_tokens") * least
    full = full.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))
    return full.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(texts > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
