"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

One hash of each shingle serves all bins: its high bits choose the bin, and the least hash in a bin is the bin's value. An empty
bin takes the value of the first full bin in an order of its own, the same for all documents. Documents with one set of shingles
are one class, and only classes go on. Bands of bins make buckets; in a bucket every member is paired with a hub, not with all
others, so pairs grow with members and not with their square. Pairs are confirmed on full sets. Where a hub's star then still
holds members of several components, those outside the hub's are compared with all of the star, block by block inside tasks, and
only links that join components come out. While that would be very many pairs a member (a giant group), some of those outside
first become hubs of their own, which joins nearly all of them at a cost that grows with members. Either way no pair of a bucket
is lost, and no pair inside what is already one component comes out of a task.

BANDS x ROWS bins: a pair with a similarity of 0.8 shares no bucket with a chance of (1 - 0.8^5)^36, about 6e-7.

Defined results: a null or wordless text has an empty set, is linked with nothing and is its own component; a row with a null id
belongs to the component of its text but is kept only where no row of the component has an id; rows that repeat an id are
documents of their own, and kept if theirs is the component's least id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.graph import components

from .common import bounded, cut, cut_small, drop, hold, let_go, pieces, text_buffer, text_key
from .words import LOWER, SEEDS, hash_words, mix, split

U = np.uint64
ROWS, BANDS = 5, 36
BINS = ROWS * BANDS
#: Hubs a star gets in each round after the first; a bin's order of full bins is walked for so many steps, and then looked up.
HUBS, WALK = 8, 24
#: Members that a task compares with as many others; open stars are searched out up to so many pairs a member.
BLOCK, FINISH = 256, 1 << 16


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begin): the distinct shingles of each text, sorted, one text after the other."""
    data = LOWER[data]
    starts, ends, first = split(data, at)
    h = hash_words(data, starts, ends)
    words = np.diff(first)
    if not len(h):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    g = mix(h + SEEDS[1])
    for k in range(1, width):
        later = np.concatenate([h[k:], np.zeros(min(k, len(h)), U)])
        g = mix((g ^ later) * SEEDS[0])
    out, sizes = [], np.zeros(len(words), np.int64)
    for k, (a, n) in enumerate(zip(first.tolist(), words.tolist(), strict=False)):
        if n >= width:
            some = np.sort(g[a : a + n - width + 1])
            some = some[np.concatenate([[True], some[1:] != some[:-1]])]
        elif n:  # all words as one
            some = mix(np.bitwise_xor.reduce(mix(h[a : a + n] + np.arange(1, n + 1, dtype=U) * SEEDS[1]), keepdims=True) + U(n))
        else:
            continue
        out.append(some)
        sizes[k] = len(some)
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=1)
def orders() -> tuple[np.ndarray, np.ndarray]:
    """(walk, rank): for each bin the order in which it looks for a full one, and each bin's place in it."""
    noise = mix(np.arange(BINS * BINS, dtype=U) * SEEDS[0] + SEEDS[1]).reshape(BINS, BINS)
    walk = np.argsort(noise, axis=1, kind="stable")
    return walk, np.argsort(walk, axis=1)


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """texts x BINS values; texts without shingles get zeros."""
    n = len(begin) - 1
    out, full = np.zeros((n, BINS), U), np.zeros((n, BINS), bool)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(n), np.diff(begin))
    slot = row * BINS + (((hashes >> U(32)) * U(BINS)) >> U(32)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))  # sorted: the first in a bin is its least
    out.reshape(-1)[slot[lead]] = mix(hashes[lead])
    full.reshape(-1)[slot[lead]] = True
    walk, rank = orders()
    r, c = np.nonzero(~full & (np.diff(begin) > 0)[:, None])
    for step in range(WALK):
        donor = walk[c, step]
        found = full[r, donor]
        out[r[found], c[found]] = out[r[found], donor[found]]
        r, c = r[~found], c[~found]
    for k in np.unique(r):
        have, empty = np.flatnonzero(full[k]), c[r == k]
        out[k, empty] = out[k, have[np.argmin(rank[np.ix_(empty, have)], axis=1)]]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """texts x BANDS bucket keys."""
    values = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U) * SEEDS[1]), values.shape[:2])
    for k in range(ROWS):
        key = mix((key ^ values[:, :, k]) * SEEDS[0])
    return key


def digest(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    out = []
    for seed in SEEDS:
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes * seed + seed))])
        out.append(mix(total[begin[1:]] - total[begin[:-1]]))
    return out[0], out[1]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """docs: d (an id), text. d, k1, k3 (of the row), n (shingles), c1, c2 (of the set), keys (of its buckets) of each row."""
    k1, k2 = text_key(F.col("text"))
    rows = docs.select("d", k1, F.xxhash64("d", k1, k2).alias("k3"), "text")
    kind = rows.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                hashes, begin = shingles(*text_buffer(some.column("text")), width)
                c1, c2 = digest(hashes, begin)
                n = np.diff(begin)
                keys = band_keys(signatures(hashes, begin)).astype(np.int64)[n > 0].reshape(-1)
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("d", "k1", "k3")), pa.array(n), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys))], ["d", "k1", "k3", "n", "c1", "c2", "keys"])

    return rows.mapInArrow(run, f"d {kind}, k1 long, k3 long, n long, c1 long, c2 long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """vid, set of the classes in wanted (vid, k1, k3), from the texts of their rows."""
    k1, k2 = text_key(F.col("text"))
    # By the same kind of join at every size; the list of wanted rows grows with the input.
    rows = docs.select(k1, F.xxhash64("d", k1, k2).alias("k3"), "text").join(wanted.hint("merge"), ["k1", "k3"]).dropDuplicates(["k1", "k3"]).select("vid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                hashes, begin = shingles(*text_buffer(some.column("text")), width)
                yield pa.RecordBatch.from_arrays([some.column("vid"), pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(hashes.view(np.int64)))], ["vid", "set"])

    return rows.mapInArrow(run, "vid long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are links, by their full sets."""
    both = pairs.join(sets.select(F.col("vid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("vid").alias("b"), F.col("set").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def searched_out(here: DataFrame, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join the components of a star, from comparing what is outside its hub's component with all of it.

    here: key, vid, label, rest of all members; open_: key, m, r of the stars to search, with members and members outside.
    A task compares up to BLOCK members outside with up to BLOCK others on full sets, and gives links only as far as they join
    what wasn't joined before, fewer than it has members.
    """
    rows = here.select("key", "vid", "label", "rest").join(open_, "key").withColumn("mb", F.ceil(F.col("m") / BLOCK)).withColumn("rb", F.ceil(F.col("r") / BLOCK))
    i, j = F.pmod(F.xxhash64("vid", F.lit(2)), F.col("rb")), F.pmod(F.xxhash64("vid", F.lit(3)), F.col("mb"))
    one = (F.col("mb") == 1) & (F.col("rb") == 1)
    small = rows.filter(one).select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "vid", "label", F.col("rest").alias("left"), F.lit(True).alias("right"))
    others = rows.filter(~one).select("key", F.explode(F.expr("sequence(0L, rb - 1)")).alias("i"), j.alias("j"), "vid", "label", F.lit(False).alias("left"), F.lit(True).alias("right"))
    outside = rows.filter(~one & F.col("rest")).select("key", i.alias("i"), F.explode(F.expr("sequence(0L, mb - 1)")).alias("j"), "vid", "label", F.lit(True).alias("left"), F.lit(False).alias("right"))
    dealt = small.union(others).union(outside).join(sets, "vid")

    def compare(table: pa.Table) -> pa.Table:
        column = table.column("set").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        _, code = np.unique(column.flatten().to_numpy(), return_inverse=True)
        member = np.repeat(np.arange(len(sizes)), sizes)
        often = np.bincount(code) > 1 if len(code) else np.zeros(0, bool)  # what one member has alone is in no intersection
        member, code = member[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        label, vid = table.column("label").to_numpy(), table.column("vid").to_numpy()
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(code, kind="stable")
        code, member = code[order], member[order]
        wide = 1 << 12
        for begin in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
            at = slice(*np.searchsorted(code, [begin, begin + wide]))
            held = np.zeros((len(sizes), wide), np.float32)
            held[member[at], code[at] - begin] = 1
            common += held[left] @ held[right].T
        i = common.astype(np.int64)
        linked = (100 * i >= percent * (sizes[left][:, None] + sizes[right][None, :] - i)) & (label[left][:, None] != label[right][None, :])
        root = {int(x): int(x) for x in np.unique(label)}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for p, q in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            a, b = find(int(label[left[p]])), find(int(label[right[q]]))
            if a != b:
                root[a] = b
                found.append((int(vid[left[p]]), int(vid[right[q]])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, width: int, percent: int, report: dict | None) -> DataFrame:
    """d, k1, k3, n, root (of the component of the row's set; null without shingles) of each row of docs (d, text)."""
    said = report if report is not None else {}
    held: list[DataFrame] = []
    table = hold(sketches(docs, width), held)
    # One row for each set of shingles; the row that its text is read from is its least.
    least = F.min(F.struct("d", "k1", "k3")).alias("r")
    classes = table.filter("n > 0").groupBy("c1", "c2", "n").agg(least, F.any_value("keys").alias("keys"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("vid"), "c1", "c2", "n", "r.k1", "r.k3", "keys"), "classes")
    members = classes.select(F.explode("keys").alias("key"), "vid", "n")
    hubs = hold(members.groupBy("key").agg(F.min(F.struct("vid", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("key", "hub"), held)
    shared = hold(members.join(hubs, "key").select("key", "vid", "n", F.col("hub.vid").alias("hub"), F.col("hub.n").alias("hub_n")), held)
    # A hub's star: all that share a bucket whose hub it is. What shares a bucket is in one star, and a pair's many buckets are few stars.
    stars = hold(shared.select(F.col("hub").alias("key"), "vid", "n", "hub", "hub_n").distinct(), held)
    wanted = hold(shared.select("vid").distinct().join(classes.select("vid", "k1", "k3"), "vid"), held)
    sets = cut(sets_of(docs, wanted, width), "sets")
    near = F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    pairs = hold(stars.filter("vid <> hub").filter(near).select(F.col("vid").alias("a"), F.col("hub").alias("b")), held)
    known, links, used = pairs, hold(confirmed(pairs, sets, percent), held), None
    rounds = said.setdefault("rounds", [])
    while True:
        roots = components(links)
        # Stars whose members are not all in the component of the hub are open: some of their pairs weren't compared.
        here = stars.join(roots.withColumnRenamed("node", "vid"), "vid", "left").withColumn("label", F.coalesce("root", "vid")).drop("root")
        here = here.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").withColumn("rest", F.col("label") != F.coalesce("hub_root", "hub"))
        here = hold(here.select("key", "vid", "n", "label", "rest"), held)
        sizes = here.groupBy("key").agg(F.count("*").alias("m"), F.count_if("rest").alias("r"))
        open_ = hold(sizes.filter("m > 2 AND r > 0"), held)  # in a star of two the hub has met the other
        row = open_.agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("r")).alias("pairs")).first()
        rounds.append({"links": links.count(), "open": row.n, "pairs": row.pairs})
        if not row.n:
            break
        if row.pairs <= FINISH * row.m:
            links = links.union(hold(searched_out(here, open_, sets, percent), held))
            roots = components(links)
            break
        # Too many to search out: up to HUBS more hubs for each star, from outside the component of its own.
        rest = here.filter("rest").join(open_.select("key"), "key", "left_semi")
        rest = rest if used is None else rest.join(used, ["key", "vid"], "left_anti")
        turn = F.min(F.struct("vid", "n", "label")).alias("h")
        chosen = cut_small(rest.groupBy("key", F.pmod(F.xxhash64("vid"), F.lit(HUBS)).alias("part")).agg(turn).select("key", F.col("h.vid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("of")), "hubs")
        if not chosen.limit(1).count():
            break  # every member outside has been a hub
        used = chosen.select("key", F.col("hub").alias("vid")) if used is None else used.union(chosen.select("key", F.col("hub").alias("vid")))
        met = here.select("key", "vid", "n", "label").join(chosen, "key").filter("label <> of").filter(near)
        pairs = met.select(F.greatest("vid", "hub").alias("a"), F.least("vid", "hub").alias("b")).distinct()
        pairs = cut_small(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
        known, links = known.union(pairs), links.union(cut_small(confirmed(pairs, sets, percent), "right"))
    # Component of each class, and the least id of each component.
    final = classes.select("vid", "c1", "c2", "n").join(roots.withColumnRenamed("node", "vid"), "vid", "left").select("c1", "c2", "n", F.coalesce("root", "vid").alias("root"))
    final = hold(final, held)
    rooted = cut(table.select("d", "k1", "k3", "n", "c1", "c2").join(final, ["c1", "c2", "n"], "left").select("d", "k1", "k3", "n", "root"), "rooted")
    let_go(held)
    for done in (classes, sets):
        drop(done)
    return rooted


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, report: dict | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links), kept (doc_id is that) of each row.

    Rows are linked when 100 x shingles in common >= percent x shingles in either. report: gets the counts of each round.
    """
    docs = bounded(docs)
    of = grouped(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text")), width, percent, report)
    heads = cut_small(of.filter("root IS NOT NULL").groupBy("root").agg(F.min("d").alias("component_id")), "heads")
    some = of.filter("root IS NOT NULL").join(heads, "root").select("d", "n", "component_id")
    every = some.union(of.filter("root IS NULL").select("d", "n", F.col("d").alias("component_id")))
    return every.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("d") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the least by id and then by text, with all columns as they came; rows without words stay.

    Of rows with one id and one text, that with the least other columns, as JSON, stays.
    """
    docs = bounded(docs)
    k1, k2 = text_key(F.col(text))
    keyed = docs.select(k1, F.xxhash64(doc_id, k1, k2).alias("k3"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    of = grouped(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text")), width, percent, None)
    heads = of.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "k1", "k3")).alias("r")).select("r.k1", "r.k3")
    wordless = ~F.coalesce(F.col(f"row.`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    heads = cut_small(heads, "heads")
    drop(of)
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (doc_id, text)]))
    chosen = keyed.join(heads, ["k1", "k3"], "left_semi").groupBy("k1", "k3").agg(F.min_by("row", rest).alias("row")).select("row")
    return chosen.select("row.*").union(keyed.filter(wordless).select("row.*"))
