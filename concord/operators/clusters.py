"""Grouping of copies: first-fit clusters in order of arrival, splits of rotations, snapshots, folding, shared rows.

What depends on the order of arrival is a state machine inside one key (a page, a carousel, a line), written as a function over
that key's rows in order; the key is what spreads the work. What doesn't is windows and aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.operators import votes
from concord.operators.graph import components
from concord.plans.work import cut_small, shipped

#: Named weights of similarity: of a header, of a text row, of its length agreeing, and the least similarity of a group.
PROFILES = {"even": (1.0, 1.0, 0.0, 0.80), "text": (0.25, 1.0, 0.5, 0.85), "strict": (1.0, 1.0, 1.0, 0.92), "loose": (0.0, 1.0, 0.0, 0.65)}


def rows_of(texts: Sequence[str], width: int) -> np.ndarray:
    """Texts as bytes, padded with spaces."""
    return np.frombuffer("".join((t or "")[:width].ljust(width) for t in texts).encode("latin-1", "replace"), np.uint8).reshape(len(texts), width)


def first_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, *, width: int = 40, most: int = 6, least: int = 1, recentre: bool = False) -> DataFrame:
    """df with cluster (from 1, by first member) and members: each row joins the first cluster whose centre differs in at most `most` places, else founds one; clusters with fewer than `least` members are left out.

    The centre is the founder, or with recentre the commonest character of each place so far (ties to the smallest).
    """

    names = df.columns

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        data, centres, tallies, label = rows_of(rows[text].tolist(), width), [], [], []
        for x in data:
            found = -1
            if centres:
                near = np.flatnonzero((np.array(centres) != x).sum(axis=1) <= most)
                found = int(near[0]) if len(near) else -1
            if found < 0:
                found = len(centres)
                centres.append(x)
                tallies.append(np.zeros((width, 256), np.int32))
            tallies[found][np.arange(width), x] += 1
            if recentre:
                centres[found] = tallies[found].argmax(axis=1).astype(np.uint8)
            label.append(found + 1)
        rows["cluster"] = label
        rows["members"] = rows.groupby("cluster")["cluster"].transform("size").astype("int64")
        rows = rows[rows["members"] >= least]
        return rows[[*names, "cluster", "members"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return shipped(df).groupBy(*keys).applyInPandas(fit, f"{kinds}, cluster int, members long")


def custom_groups(pages: DataFrame, keys: Sequence[str], order: str, header: str, text: str, profile: str = "even") -> DataFrame:
    """keys, order, group: copies of a page grouped first-fit by a weighted similarity of header and text."""
    heads, bodies, sizes, limit = PROFILES[profile]

    def alike(a: tuple[str, str], b: tuple[str, str]) -> float:
        def share(x: str, y: str) -> float:
            n = max(len(x), len(y))
            return 1.0 if not n else sum(p == q for p, q in zip(x, y, strict=False)) / n

        length = 1 - abs(len(a[1]) - len(b[1])) / max(len(a[1]), len(b[1]), 1)
        return (heads * share(a[0], b[0]) + bodies * share(a[1], b[1]) + sizes * length) / (heads + bodies + sizes)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows, founders, label = rows.sort_values(order, kind="stable"), [], []
        for x in zip(rows[header].fillna(""), rows[text].fillna(""), strict=True):
            found = next((k for k, f in enumerate(founders) if alike(f, x) >= limit), None)
            if found is None:
                found = len(founders)
                founders.append(x)
            label.append(found + 1)
        rows["group"] = label
        return rows[[*keys, order, "group"]]

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return shipped(pages).groupBy(*keys).applyInPandas(fit, f"{kinds}, group int")


def consensus_quality(cells: DataFrame, keys: Sequence[str], group: str, place: str, value: str) -> DataFrame:
    """keys, quality: how well a grouping explains its copies. For each group the share of places that agree, raised by its support, less what it leaves uncovered; a key has the mean over its groups.

    quality = agreement x (1 + 0.35 x min(log2 copies, 3)) - 0.75 x (places of the key that the group hasn't).
    """
    won = votes.vote(cells, [*keys, group, place], value)
    total = cells.groupBy(*keys).agg(F.countDistinct(place).alias("_all"))
    by = won.groupBy(*keys, group).agg(F.avg(F.col("votes") / F.col("total")).alias("_agree"), F.max("total").alias("_n"), F.count("*").alias("_have"))
    support = 1 + 0.35 * F.least(F.log2(F.col("_n")), F.lit(3.0))
    scored = by.join(total, list(keys)).withColumn("_q", F.col("_agree") * support - 0.75 * (1 - F.col("_have") / F.col("_all")))
    return scored.groupBy(*keys).agg(F.round(F.avg("_q"), 6).alias("quality"))


def choose_grouping(first: DataFrame, second: DataFrame, keys: Sequence[str], ratio: float = 1.15) -> DataFrame:
    """keys, chosen (1 or 2): the second grouping where its quality is more than `ratio` times the first's."""
    both = first.select(*keys, F.col("quality").alias("_a")).join(second.select(*keys, F.col("quality").alias("_b")), list(keys))
    return both.select(*keys, F.when(F.col("_b") > ratio * F.col("_a"), 2).otherwise(1).alias("chosen"))


def split_rotation(rows: DataFrame, keys: Sequence[str], copy: str, row: str, text: str) -> DataFrame:
    """copy, part (the least copy of its part): copies of a page belong together if they share a row and contradict none.

    rows: keys, copy (a number that is unique over all keys), row, text (null where it wasn't read). Copies with equal content are
    one class first. Copies that have rows S meet copies that have rows T at what they read in the rows of both: they contradict
    nowhere if that is equal, and then all of one kind belong to all of the other. So a copy is listed once for each T of its page,
    not once for each copy that shares a row number with it.
    """
    content = rows.groupBy(*keys, copy).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(text).alias("t")))).alias("_x"))
    classes = cut_small(content.groupBy(*keys, F.xxhash64("_x").alias("_c")).agg(F.min(copy).alias("_h"), F.any_value("_x").alias("_x")), "classes")
    of = content.select(*keys, copy, F.xxhash64("_x").alias("_c")).join(classes.select(*keys, "_c", "_h"), [*keys, "_c"]).select(copy, "_h")
    one = classes.select(*keys, "_h", F.filter("_x", lambda x: x["t"].isNotNull()).alias("_x")).withColumn("_s", F.transform("_x", lambda x: x["r"]))
    kinds = one.select(*keys, "_s").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("_s", "_t"), list(keys)).filter(F.arrays_overlap("_s", "_t"))
    both = F.filter("_x", lambda x: F.array_contains("_t", x["r"]))
    key = [F.when(F.col("_s") < F.col("_t"), F.col("_s")).otherwise(F.col("_t")), F.when(F.col("_s") < F.col("_t"), F.col("_t")).otherwise(F.col("_s")), both]
    side = F.when(F.col("_s") < F.col("_t"), 0).when(F.col("_s") > F.col("_t"), 1)  # null: rows S meet rows S
    met = one.join(pairs, [*keys, "_s"]).select(*keys, F.xxhash64(*key).alias("_k"), F.xxhash64(F.lit(1), *key).alias("_l"), "_h", side.alias("_side"))
    groups = met.groupBy(*keys, "_k", "_l").agg(F.min("_h").alias("_m"), F.max("_h").alias("_z"), F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    groups = groups.filter("_m < _z AND (_a IS NULL OR _a < _b)").select(*keys, "_k", "_l", "_m")
    links = met.join(groups, [*keys, "_k", "_l"]).filter("_h > _m").select(F.col("_h").alias("a"), F.col("_m").alias("b"))
    return of.join(components(links), F.col("_h") == F.col("node"), "left").select(F.col(copy), F.coalesce("root", "_h").alias("part"))


def snapshots(df: DataFrame, keys: Sequence[str], order: str, row: str, value: str) -> DataFrame:
    """keys, state (from 0), order, row, value: the rows that changed, each with the number of the state it began; rows of one order are one change."""
    w = W.partitionBy(*keys, row).orderBy(order)
    moved = df.withColumn("_p", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_p")))
    return moved.withColumn("state", F.dense_rank().over(W.partitionBy(*keys).orderBy(order)) - 1).select(*keys, "state", order, row, value)


def fold_messages(df: DataFrame, keys: Sequence[str], at: str, content: str, gap: int = 2) -> DataFrame:
    """keys, content, first, last, copies, missed: repeats of a message that are at most `gap` apart, with how many steps between them it was missed."""
    w = W.partitionBy(*keys, content).orderBy(at)
    step = F.col(at) - F.lag(at).over(w)
    run = F.sum(F.when(step <= gap, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_run", run).groupBy(*keys, content, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("copies")).withColumn("missed", F.col("last") - F.col("first") + 1 - F.col("copies")).drop("_run")


def shared_rows(rows: DataFrame, page: str, sub: str, row: str, text: str, *, most: int = 3, width: int = 40) -> DataFrame:
    """page, sub, row, text, filled: rows that are nearly alike on all subpages that have them, filled in on those that lack them."""
    top = votes.vote(rows, [page, row], text).select(page, row, F.col(text).alias("_top"))
    pad = lambda c: F.split(F.rpad(F.col(c), width, " "), "")
    off = F.aggregate(F.zip_with(pad(text), pad("_top"), lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    alike = rows.join(top, [page, row]).withColumn("_off", off).groupBy(page, row).agg(F.max("_off").alias("_worst"), F.countDistinct(sub).alias("_subs"), F.first("_top").alias("_top"))
    common = alike.filter((F.col("_worst") <= most) & (F.col("_subs") > 1)).select(page, row, "_top")
    want = rows.select(page, sub).distinct().join(common, page)
    return want.join(rows.select(page, sub, row, F.col(text)), [page, sub, row], "full_outer").select(page, sub, row, F.coalesce(text, "_top").alias(text), F.col(text).isNull().alias("filled"))


def align(copy: bytes, base: bytes, reach: int = 8) -> int:
    """The slip (places to move the copy to the right) at which most bytes agree; ties to the smallest move."""
    a, b = np.frombuffer(copy, np.uint8), np.frombuffer(base, np.uint8)

    def same(s: int) -> int:
        x, y = (a[: len(b) - s], b[s:]) if s >= 0 else (a[-s:], b)
        n = min(len(x), len(y))
        return int((x[:n] == y[:n]).sum())

    return max(range(-reach, reach + 1), key=lambda s: (same(s), -abs(s), s))


def vote_with_slip(df: DataFrame, keys: Sequence[str], order: str, data: str, *, reach: int = 8, outlier: float = 0.5) -> DataFrame:
    """keys, data, copies, dropped: copies moved to where they agree with the commonest one, those that agree on less than `outlier` of at least 16 bytes left out, and the rest voted byte by byte (ties to the smallest)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        copies = [bytes(x) for x in rows[data] if x is not None]
        if not copies:
            return pd.DataFrame([(*[rows[k].iloc[0] for k in keys], None, 0, 0)], columns=[*keys, data, "copies", "dropped"])
        size = int(pd.Series([len(c) for c in copies]).mode().min())
        base = max(sorted(c for c in set(copies) if len(c) == size), key=copies.count)
        tally, dropped = np.zeros((size, 256), np.int32), 0
        for c in copies:
            s = align(c, base, reach)
            at = np.arange(len(c)) + s
            inside = (at >= 0) & (at < size)
            raw, at = np.frombuffer(c, np.uint8)[inside], at[inside]
            if len(raw) >= 16 and (raw == np.frombuffer(base, np.uint8)[at]).mean() < outlier:
                dropped += 1
                continue
            tally[at, raw] += 1
        return pd.DataFrame([(*[rows[k].iloc[0] for k in keys], tally.argmax(axis=1).astype(np.uint8).tobytes(), len(copies), dropped)], columns=[*keys, data, "copies", "dropped"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return shipped(df).groupBy(*keys).applyInPandas(run, f"{kinds}, {data} binary, copies int, dropped int")


def combine_copies(df: DataFrame, keys: Sequence[str], data: str, order: Column) -> DataFrame:
    """keys, data: copies of a file put together byte by byte; a zero is a byte that wasn't read, and of different ones the commonest stays (ties to the smallest)."""
    from concord.functions import columns as K

    each = df.select(*keys, F.posexplode(K.byte_list(F.col(data))).alias("place", "byte"))
    won = votes.vote(each.filter("byte <> 0"), [*keys, "place"], "byte")
    size = df.groupBy(*keys).agg(F.max(F.length(data)).alias("_size"))
    filled = won.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "byte"))).alias("_m"))
    hexed = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.lpad(F.hex(F.coalesce(F.element_at("_m", i), F.lit(0))), 2, "0"))
    return size.filter("_size > 0").join(filled, list(keys), "left").withColumn("_m", F.coalesce("_m", F.create_map().cast("map<int,int>"))).select(*keys, F.unhex(F.array_join(hexed, "")).alias(data))

