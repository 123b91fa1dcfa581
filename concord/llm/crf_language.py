"""Language ID by a linear-chain conditional random field over words.

Each word has features: the word itself (lexicon), its affixes of one to four bytes, and its byte n-grams of two and three, all
hashed into a fixed table of weights for each language; learned transitions join neighbouring words. Forward-backward gives
every word a distribution over languages, so that the parts of code-switched text are told apart, and a document's language is
the one with the largest share of words with letters.

Training takes all words of all distinct texts. Texts are dealt by a hash to shards of about SHARD bytes; each shard learns a field of
the languages in it, in small steps over sequences that switch language after a few words, so that transitions can be learnt, and
a weight is the mean of those of the shards that have its language. The field depends on the texts alone, not on partitions. Pieces
of a language with few words in a shard are repeated there, so that it isn't drowned; nothing is left out. Predictions read whole
texts: long ones in chunks whose transfer matrices are multiplied together, which is the same chain. Memory grows in proportion to
the number of languages, on the driver (weights) and in workers (weights of a shard's languages, marginals). `fit` learns from
excerpts instead, and `excerpts` takes a bounded sample for it; no query does.

Defined results: null text, or text without a letter, is `und` with score 0; without training documents all are; a row without
an id is neither trained on nor held out; repeated rows count as often as they are there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, cut_small, pieces, text_buffer
from .words import LOWER, SEEDS, SPACE, hash_words, mix, split

U = np.uint64
PER_LANGUAGE, EXCERPT, SAMPLE = 400, 1500, 25_600
#: Weights of a language, words of a training sequence, sequences (or so many a language), training steps, words of a chunk, numbers
#: of an array over sequences in training.
SLOTS, LENGTH, SEQUENCES, EACH, STEPS, CHUNK, AT_ONCE = 1 << 16, 48, 3000, 40, 60, 256, 1 << 21
#: Bytes of text of a shard, how often pieces of a language with few words are there at most, parts in which weights travel, texts
#: that a task remembers to leave out their copies.
SHARD, AGAIN, BLOCKS, SEEN = 8 << 20, 16, 16, 500_000
#: Bytes of text that a learner splits into words at once, features that it looks at at once: an executor has room for little more.
GROUP, FEATURES = 1 << 18, 1 << 20
UNDETERMINED = "und"
BLANKS = [bytes([b]) for b in np.flatnonzero(SPACE)]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of every feature of the words at starts:ends, words ascending within each kind of feature. data: lower case."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(shape=(len(data),), dtype="<u8", buffer=padded.data, strides=(1,))
    number, length = np.arange(len(starts)), ends - starts
    word, code = [number], [hash_words(data, starts, ends)]

    def put(of: np.ndarray, at: np.ndarray, size: int, kind: int) -> None:
        word.append(of)
        code.append(mix((loads[at] & U((1 << (8 * size)) - 1)) * SEEDS[1] + U(kind)))

    for size in (1, 2, 3, 4):
        long = length >= size
        put(number[long], starts[long], size, size)
        put(number[long], ends[long] - size, size, 10 + size)
    for size in (2, 3):
        grams = np.maximum(length - size + 1, 0)
        of = np.repeat(number, grams)
        put(of, np.repeat(starts - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum())), size, 20 + size)
    return np.concatenate(word), (np.concatenate(code) % U(SLOTS)).astype(np.int64)


def forward_backward(pot: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """words x languages marginals. pot: potentials of words, first: where each chain begins (and one past the last), step[i, j]: from i to j."""
    n, k = pot.shape
    out = np.zeros((n, k), np.float32)
    sizes = np.diff(first)
    chains = np.flatnonzero(sizes > 0)
    if not len(chains):
        return out
    chunk = CHUNK * max(1, k * k // 4096)  # transfer matrices of many languages are large, so there are fewer
    parts = -(-sizes[chains] // chunk)
    head = np.concatenate([[0], np.cumsum(parts)])
    of = np.repeat(np.arange(len(chains)), parts)
    begin = first[chains][of] + chunk * (np.arange(len(of)) - head[of])
    size = np.minimum(chunk, first[chains + 1][of] - begin)
    order = np.argsort(-size, kind="stable")  # longest first, so that those still running are a prefix
    begin, size = begin[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    running = np.searchsorted(-size, -np.arange(chunk), "left")  # chunks with more words than t
    steps = int(size[0])
    step = step.astype(np.float32)
    entry = np.tile(start.astype(np.float32), (len(order), 1))
    leave = np.ones((len(order), k), np.float32)
    if head[-1] > len(chains):  # chains of several chunks: what enters and what follows each
        whole = np.zeros((len(order), k, k), np.float32)
        whole[:, np.arange(k), np.arange(k)] = pot[begin]
        for t in range(1, steps):
            m = running[t]
            x = (whole[:m].reshape(m * k, k) @ step).reshape(m, k, k) * pot[begin[:m] + t][:, None, :]
            whole[:m] = x / x.sum(axis=(1, 2), keepdims=True)
        rank = np.arange(len(of)) - head[of]
        for j in range(1, int(parts.max())):  # chunk j of all chains that have one
            here = np.flatnonzero(rank == j)
            before = place[here - 1]
            x = np.einsum("ni,nij->nj", entry[before], whole[before]) @ step
            entry[place[here]] = x / x.sum(axis=1, keepdims=True)
        back = parts[of] - 1 - rank
        for j in range(1, int(parts.max())):  # the j-th chunk from the end
            here = np.flatnonzero(back == j)
            after = place[here + 1]
            x = np.einsum("nij,nj->ni", whole[after], leave[after]) @ step.T
            leave[place[here]] = x / x.sum(axis=1, keepdims=True)
    a = entry
    for t in range(steps):
        m = running[t]
        at = begin[:m] + t
        a = a[:m] * pot[at] if t == 0 else (a[:m] @ step) * pot[at]
        a /= a.sum(axis=1, keepdims=True)
        out[at] = a
    for t in range(steps - 1, -1, -1):
        m = running[t]
        at = begin[:m] + t
        b = leave[:m]
        x = out[at] * b
        out[at] = x / x.sum(axis=1, keepdims=True)
        if t:
            b = (pot[at] * b) @ step.T
            leave[:m] = b / b.sum(axis=1, keepdims=True)
    return out


class Crf:
    """languages, weights (SLOTS x languages), start, step (scores of transitions)."""

    def __init__(self, languages: list[str], weights: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.languages, self.weights, self.start, self.step = languages, weights.astype(np.float32), start, step

    def potentials(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct words x languages, the distinct word that each is)."""
        _, lead, which = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        word, slot = features(data, starts[lead], ends[lead])
        score = np.stack([np.bincount(word, self.weights[slot, j], len(lead)) for j in range(len(self.languages))], axis=1)
        return np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30)).astype(np.float32), which

    def marginals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x languages, first word of each text, which words have letters)."""
        data, at = text_buffer(column)
        data = LOWER[data]
        starts, ends, first = split(data, at)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), first, np.zeros(0, bool)
        pot, which = self.potentials(data, starts, ends)
        letters = np.concatenate([[0], np.cumsum((data >= 0x80) | ((data >= 0x61) & (data <= 0x7A)))])
        lettered = letters[ends] > letters[starts]
        return forward_backward(pot[which], first, np.exp(self.start - self.start.max()), np.exp(self.step - self.step.max())), first, lettered

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number, its share of words with letters) of each text; -1 where no word has one."""
        share, first, lettered = self.marginals(column)
        total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(share * lettered[:, None], axis=0, dtype=np.float64)])[first]
        words = np.concatenate([[0], np.cumsum(lettered)])[first]
        sums, n = np.diff(total, axis=0), np.diff(words)
        best = sums.argmax(axis=1)
        score = np.clip(sums[np.arange(len(best)), best] / np.maximum(n, 1), 0, 1)
        return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0)


def gradient(pot: np.ndarray, y: np.ndarray, begin: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(truth less expectation of each word's label, and of each pair of neighbouring labels) of sequences of one length.

    pot: sequences x words x languages, y: the true labels, begin and trans: potentials of the first label and of transitions. These
    are the derivatives of the log likelihood by the scores whose exponentials the potentials are.
    """
    n, length, k = pot.shape
    alpha, beta = np.empty(pot.shape), np.ones(pot.shape)
    for t in range(length):
        a = (begin if t == 0 else alpha[:, t - 1] @ trans) * pot[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:, :-1], y[:, 1:]), 1)
    for t in range(length - 2, -1, -1):
        ahead = pot[:, t + 1] * beta[:, t + 1]
        b = ahead @ trans.T
        pairs -= trans * ((alpha[:, t] / (alpha[:, t] * b).sum(axis=1, keepdims=True)).T @ ahead)
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    gap = -post
    gap[np.arange(n)[:, None], np.arange(length), y] += 1
    return gap, pairs


def fit(excerpts: list[tuple[str, str]], seed: int = 7) -> Crf | None:
    """A field learnt from (text, language) excerpts, by Adam on the conditional likelihood of mixed sequences."""
    languages = sorted({lang for _, lang in excerpts})
    data, at = text_buffer(pa.array([t for t, _ in excerpts], pa.string()))
    data = LOWER[data]
    starts, ends, first = split(data, at)
    label = np.repeat([languages.index(lang) for _, lang in excerpts], np.diff(first)) if excerpts else np.zeros(0, np.int64)
    if not len(starts):
        return None
    rng, k = np.random.default_rng(seed), len(languages)
    # Sequences: pieces of 4 to 24 words from documents of any language, end to end.
    of = np.array([languages.index(lang) for _, lang in excerpts])
    docs = [d[np.diff(first)[d] > 0] for d in (np.flatnonzero(of == j) for j in range(k))]
    some = [j for j in range(k) if len(docs[j])]
    index = np.zeros((max(SEQUENCES, EACH * len(some)), LENGTH), np.int64)
    for row in index:
        filled = 0
        while filled < LENGTH:
            d = rng.choice(docs[rng.choice(some)])
            n = first[d + 1] - first[d]
            take = min(int(rng.integers(4, 25)), LENGTH - filled, n)
            begin = first[d] + int(rng.integers(0, n - take + 1))
            row[filled : filled + take] = np.arange(begin, begin + take)
            filled += take
    _, lead, which = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
    # Only words of the sequences are learnt from.
    held, x = np.unique(which[index], return_inverse=True)
    x, y = x.reshape(index.shape), label[index]
    word, slot = features(data, starts[lead[held]], ends[lead[held]])
    used, column = np.unique(slot, return_inverse=True)
    weights, start, step = np.zeros((len(used), k)), np.zeros(k), np.eye(k)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, start, step)]
    parts = np.array_split(np.arange(len(x)), -(-x.size * k // AT_ONCE))
    for turn in range(1, STEPS + 1):
        score = np.stack([np.bincount(word, weights[column, j], len(held)) for j in range(k)], axis=1)
        pot = np.exp(score - score.max(axis=1, keepdims=True))
        by_word, grads = np.zeros((len(held), k)), [np.zeros_like(p) for p in (weights, start, step)]
        for part in parts:
            gap, pairs = gradient(pot[x[part]], y[part], np.exp(start - start.max()), np.exp(step - step.max()))
            grads[1] += gap[:, 0].sum(axis=0)
            grads[2] += pairs
            flat, gap = x[part].ravel(), gap.reshape(-1, k)
            for j in range(k):
                by_word[:, j] += np.bincount(flat, gap[:, j], len(held))
        for j in range(k):
            grads[0][:, j] = np.bincount(column, by_word[word, j], len(used))
        for p, g, m, pull in zip((weights, start, step), grads, moments, (0.02, 0.1, 0.1), strict=True):
            g -= pull * p
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p += 0.1 * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-8)
    full = np.zeros((SLOTS, k))
    full[used] = weights
    return Crf(languages, full, start, step)


class Learner:
    """A field learnt by Adam in small steps from all words of all texts that it is given."""

    def __init__(self, languages: list[str], shard: int):
        self.languages, self.rng, self.turn = languages, np.random.default_rng([7, shard]), 0
        k = len(languages)
        self.seen = np.zeros(k, bool)
        self.weights, self.start, self.step = np.zeros((SLOTS, k)), np.zeros(k), np.eye(k)
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.start, self.step)]

    def _adam(self, which: int, p: np.ndarray, g: np.ndarray, pull: float, at=slice(None)) -> None:
        one, two = self.moments[which]
        now = p[at]
        g = g - pull * now
        one[at] += 0.1 * (g - one[at])
        two[at] += 0.01 * (g * g - two[at])
        p[at] = now + 0.1 * (one[at] / (1 - 0.9**self.turn)) / (np.sqrt(two[at] / (1 - 0.99**self.turn)) + 1e-8)

    def _sequences(self, first: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Word numbers, to be read LENGTH at a time: every text cut into pieces of 4 to 24 words, and all of them dealt anew. Pieces of languages with few are there several times."""
        most = np.diff(first) // 4 + 1
        steps = self.rng.integers(4, 25, int(most.sum()))
        begin = np.cumsum(steps) - steps  # of the pieces of all texts, as if each text ended where its last piece does
        begin -= np.repeat(begin[np.cumsum(most) - most] - first[:-1], most)
        there = begin < np.repeat(first[1:], most)
        begin, which = begin[there], np.repeat(of, most)[there]
        size = np.diff(np.append(begin, first[-1]))
        words = np.bincount(which, size, len(self.languages))
        again = np.clip(np.round(words[words > 0].mean() / np.maximum(words, 1)), 1, AGAIN).astype(np.int64)
        order = self.rng.permutation(np.repeat(np.arange(len(begin)), again[which]))
        size, lead = size[order], begin[order]
        flat = np.arange(int(size.sum()), dtype=np.int32)
        flat += np.repeat((lead - (np.cumsum(size) - size)).astype(np.int32), size)
        return flat

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each text, the distinct word that each is, features of distinct words, where those of each begin). Distinct words are in the order of their hashes.

        Texts are split GROUP bytes at a time, so that only four bytes a word stay, and two a feature of a distinct word.
        """
        known, number = np.zeros(0, U), np.zeros(0, np.int32)
        counts, which, slots, sizes = [], [], [], []
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= GROUP:
                size += len(texts[end])
                end += 1
            data = LOWER[np.frombuffer(b"".join(texts[begin:end]), np.uint8)]
            starts, ends, first = split(data, np.cumsum([0, *map(len, texts[begin:end])]))
            counts.append(np.diff(first))
            begin = end
            hashes, lead, local = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(known, hashes)
            new = np.append(known, U(0))[at] != hashes
            new[at == len(known)] = True
            mine = np.append(number, np.int32(0))[at]
            mine[new] = np.arange(len(known), len(known) + int(new.sum()))
            which.append(mine[local])
            known, number = np.insert(known, at[new], hashes[new]), np.insert(number, at[new], mine[new])
            word, slot = features(data, starts[lead[new]], ends[lead[new]])
            slots.append(slot[np.argsort(word, kind="stable")].astype(np.uint16 if SLOTS <= 1 << 16 else np.uint32))
            sizes.append(np.bincount(word, minlength=int(new.sum())))
        which, slots, sizes = np.concatenate(which), np.concatenate(slots), np.concatenate(sizes)
        rank = np.empty_like(number)
        rank[number] = np.arange(len(number))
        old, size = (np.cumsum(sizes) - sizes)[number], sizes[number]
        place = np.concatenate([[0], np.cumsum(size)])
        sorted_slots = np.empty_like(slots)
        for a, b in _runs(size, FEATURES):
            sorted_slots[place[a] : place[b]] = slots[np.arange(place[a], place[b]) + np.repeat(old[a:b] - place[a:b], size[a:b])]
        return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), rank[which], sorted_slots, place

    def learn(self, texts: list[bytes], languages: list[int]) -> None:
        if not texts:
            return
        first, which, slot, begin = self._words(texts)
        if not len(which):
            return
        of, k = np.array(languages), len(self.languages)
        label = np.repeat(of.astype(np.int32), np.diff(first))
        self.seen[label] = True
        todo = STEPS
        while todo > 0:
            flat = self._sequences(first, of)
            count = -(-len(flat) // LENGTH)
            rows = int(np.clip(-(-count // STEPS), 64, max(64, AT_ONCE // (LENGTH * k * 16))))
            for at in range(0, count, rows):
                # The last row is filled up from the beginning.
                index = flat.take(np.arange(at * LENGTH, min(at + rows, count) * LENGTH), mode="wrap").reshape(-1, LENGTH)
                self._turn(which[index], label[index], slot, begin)
                todo -= 1

    def _turn(self, words: np.ndarray, y: np.ndarray, slot: np.ndarray, begin: np.ndarray) -> None:
        self.turn += 1
        k = len(self.languages)
        held, x = np.unique(words, return_inverse=True)
        x = x.reshape(words.shape)
        n = begin[held + 1] - begin[held]
        runs = _runs(n, FEATURES)

        def spread(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            word = np.repeat(np.arange(b - a), n[a:b])
            return word, slot[np.arange(len(word)) + np.repeat(begin[held[a:b]] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b])].astype(np.int64)

        kept = spread(*runs[0]) if len(runs) == 1 else None
        score, there = np.empty((len(held), k)), np.zeros(SLOTS, bool)
        for a, b in runs:
            word, own = kept or spread(a, b)
            there[own] = True
            score[a:b] = np.stack([np.bincount(word, self.weights[own, j], b - a) for j in range(k)], axis=1)
        pot = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))
        gap, pairs = gradient(pot[x], y, np.exp(self.start - self.start.max()), np.exp(self.step - self.step.max()))
        by_start, flat, gap = gap[:, 0].sum(axis=0), x.ravel(), gap.reshape(-1, k)
        by_word = np.stack([np.bincount(flat, gap[:, j], len(held)) for j in range(k)], axis=1)
        used = np.flatnonzero(there)
        grads = np.zeros((len(used), k))
        for a, b in runs:
            word, own = kept or spread(a, b)
            for j in range(k):
                grads[:, j] += np.bincount(own, by_word[a:b][word, j], SLOTS)[used]
        part = len(y) / SEQUENCES
        self._adam(0, self.weights, grads, 0.02 * part, used)
        self._adam(1, self.start, by_start, 0.1 * part)
        self._adam(2, self.step, pairs, 0.1 * part)


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbours whose sizes come to `most` together, or one that is larger: (begin, end) of each run."""
    total, found, begin = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
        found.append((begin, end))
        begin = end
    return found


def cuts(text: bytes, size: int, most: int) -> Iterator[bytes]:
    """The text in stretches of at most `size` bytes, cut behind a blank; where there is none, in one of at most `most`."""
    begin = 0
    while len(text) - begin > size:
        end = max(text.rfind(blank, begin, begin + size) for blank in BLANKS) + 1
        if end <= begin:
            end = min((at + 1 for at in (text.find(blank, begin + size, begin + most) for blank in BLANKS) if at >= 0), default=begin + most)
            if end >= len(text):
                break
        yield text[begin:end]
        begin = end
    yield text[begin:]


def fit_all(docs: DataFrame, train: Column, text: str, lang: str) -> Crf | None:
    """A field from all words of all texts that train: each shard of the distinct texts is learnt by itself, and a weight is the mean over the shards that have its language.

    A text's shard is a hash of it, and shards are sorted, so that the field depends on the texts alone.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("t"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.sum(F.octet_length("t").cast("long")).alias("n")).collect()}
    if not sizes:
        return None
    languages, shards = sorted(sizes), max(1, -(-sum(sizes.values()) // SHARD))
    number = {lang: j for j, lang in enumerate(languages)}

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most copies go before texts travel, so that those of one text don't fill a shard; those left go where it is learnt.
        seen = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column("h").to_pylist(), batch.column("l").to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))
            if len(seen) > SEEN:
                seen.clear()

    once = bounded(rows).mapInArrow(fresh, rows.schema).withColumn("s", F.pmod(F.xxhash64(F.lit(5), "h"), F.lit(shards)))
    dealt = once.repartition(min(2 * shards, 10_000), "s").sortWithinPartitions("s", "h", "l", "t")

    def learnt(shard: int, texts: list[bytes], labels: list[str]) -> Iterator[pa.RecordBatch]:
        own = sorted(set(labels))
        field = Learner(own, shard)
        local = {lang: j for j, lang in enumerate(own)}
        some, of, size = [], [], 0
        for t, lang in zip(texts, labels, strict=True):
            for piece in cuts(t, min(GROUP, SHARD), SHARD):
                if some and size + len(piece) > 2 * SHARD:
                    field.learn(some, of)
                    some, of, size = [], [], 0
                some.append(piece)
                of.append(local[lang])
                size += len(piece)
        field.learn(some, of)
        place = np.array([number[lang] for lang in own])
        for j in np.flatnonzero(field.seen):
            links = np.zeros((2, len(languages)))
            links[0, place[field.seen]], links[1, place[field.seen]] = field.step[j, field.seen], 1
            parts = [*np.split(field.weights[:, j], BLOCKS), np.concatenate([[field.start[j], 1.0], links.ravel()])]
            yield pa.RecordBatch.from_arrays([pa.array([int(place[j])] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], ["j", "b", "s", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, labels, before = None, [], [], None
        for batch in batches:
            for s, h, lang, t in zip(*(batch.column(c).to_pylist() for c in "shlt"), strict=True):
                if (h, lang) == before:
                    continue
                before = h, lang
                if s != shard and texts:
                    yield from learnt(shard, texts, labels)
                    texts, labels = [], []
                shard = s
                texts.append(t)
                labels.append(lang)
        if texts:
            yield from learnt(shard, texts, labels)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["j", "b", "p"])
        for batch in batches:
            for j, b, p in zip(*(batch.column(c).to_pylist() for c in "jbp"), strict=True):
                if (j, b) != key:
                    if key is not None:
                        yield out()
                    key, total = (j, b), 0.0
                total = total + np.frombuffer(p, "<f4").astype("<f8")
        if key is not None:
            yield out()

    shares = dealt.mapInArrow(run, "j int, b int, s long, p binary")
    sums = {(r.j, r.b): np.frombuffer(bytes(r.p), "<f8") for r in shares.repartition("j", "b").sortWithinPartitions("j", "b", "s").mapInArrow(add, "j int, b int, p binary").collect()}
    some = sorted({j for j, _ in sums})
    if not some:
        return None
    weights, start, step = np.zeros((SLOTS, len(some)), np.float32), np.zeros(len(some)), np.eye(len(some))
    for i, j in enumerate(some):
        last = sums[j, BLOCKS]
        weights[:, i] = np.concatenate([sums[j, b] for b in range(BLOCKS)]) / last[1]
        start[i] = last[0] / last[1]
        total, n = last[2:].reshape(2, -1)[:, some]
        step[i] = np.where(n > 0, total / np.maximum(n, 1), step[i])
    return Crf([languages[j] for j in some], weights, start, step)


def excerpts(docs: DataFrame, train: Column, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """The sample that is trained on, by language and hash of the text: what reaches the driver is at most SAMPLE excerpts, or one a language.

    Copies of a text count once. A first pass counts the distinct texts of each language roughly, so that the second need not sort
    many more than are wanted.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    counts = cut_small(rows.groupBy("l").agg(F.approx_count_distinct("h", 0.05).alias("n")), "languages")
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    span = 1 << 40
    limit = F.ceil(F.lit(float(span)) * (2 * each + 20) / F.col("n"))
    where = F.pmod(F.xxhash64(F.lit(3), "h"), F.greatest(F.length("t") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    near = rows.join(counts, "l").filter(F.pmod("h", F.lit(span)) < limit).select("l", "h", F.substring("t", where, F.lit(EXCERPT)).alias("t"))
    once = near.groupBy("l", "h").agg(F.min("t").alias("t"))
    picked = once.withColumn("rank", F.row_number().over(W.partitionBy("l").orderBy(F.pmod("h", F.lit(span)), "h"))).filter(F.col("rank") <= each)
    return [(r.t, r.l) for r in picked.select("l", "rank", "t").orderBy("l", "rank").collect()]


def predict(docs: DataFrame, model: Crf | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns in keep, or all), lang_pred, score of each row."""
    docs = bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = (2 << 20) * 16 // max(16, len(model.languages) if model else 0)
    names = keep if keep is not None else docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for some in pieces(batch, "text", size):
                has = some.column("has").to_numpy(zero_copy_only=False)
                best, score = crf.predict(some.column("text")) if crf else (np.full(len(has), -1), np.zeros(len(has)))
                known = np.array([*crf.languages, UNDETERMINED] if crf else [UNDETERMINED], object)
                best = np.where(has, best, -1)
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(known[best], pa.string()), pa.array(np.where(best >= 0, score, 0.0))], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: str, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf | None:
    """A field from the documents that aren't held out."""
    docs = bounded(docs)
    return fit_all(docs, F.col(doc_id).isNotNull() & ~held_out(doc_id), text, lang)


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, learnt from the rows that aren't held out."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id).alias("held_out"))
    found = predict(keyed, learn(keyed), keep=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")
