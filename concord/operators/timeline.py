"""Operators over ordered rows: breaks, runs, sessions, repairs, nearest and interval joins.

Windows are partitioned by key. Where a single key may hold most rows (one long recording), `bucketed` forms cut the order into
stretches that are joined up again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, step: Column | int = 1, modulo: int | None = None) -> DataFrame:
    """The rows whose counter isn't the previous one plus `step`; gap is by how much they miss it. The first of a key is no break."""
    w = W.partitionBy(*keys).orderBy(*order)
    gap = F.col(counter) - F.lag(counter).over(w) - (step if isinstance(step, Column) else F.lit(step))
    return df.withColumn("gap", F.pmod(gap, F.lit(modulo)) if modulo else gap).filter("gap <> 0")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, least: Column | int, most: Column | int) -> DataFrame:
    """df with island: runs of rows whose `at` grows by `least` to `most` from one to the next; numbered from 1 in each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    step = at - F.lag(at).over(w)
    new = F.when((step >= least) & (step <= most), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, keys: Sequence[str], order: str, at: Column, least: Column | int, most: Column | int, shortest: int = 2) -> DataFrame:
    """keys, first, last, n of the runs of at least `shortest` rows."""
    found = islands(df, keys, [order], at, least, most)
    return found.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= shortest).drop("island")


def collapse(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df without rows that repeat the value of the row before (nulls repeat nulls)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", F.col(value).eqNullSafe(F.lag(value).over(w))).filter("_first OR NOT _same").drop("_first", "_same")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, as an aggregation: no task holds a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """keys, value, n, rank: the k commonest values of each key, ties to the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def repair_from_neighbours(df: DataFrame, keys: Sequence[str], order: str, value: str, reach: int) -> DataFrame:
    """df with repaired: a null value filled where the values before and after agree and are closer than `reach`."""
    w = W.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    close = (F.col(order) - F.lag(order).over(w) < reach) & (F.lead(order).over(w) - F.col(order) < reach)
    return df.withColumn("repaired", F.coalesce(F.col(value), F.when((before == after) & close, before)))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with filled: the last value that isn't null, up to the row."""
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with following: the value of the next row of the key."""
    return df.withColumn("following", F.lead(value).over(W.partitionBy(*keys).orderBy(*order)))


def capped_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, cap: int) -> DataFrame:
    """df with end: the start of the next row of the key, or the start plus `cap` where that is sooner or there is none. start in seconds."""
    return df.withColumn("end", F.least(F.lead(start).over(W.partitionBy(*keys).orderBy(*order)), F.col(start) + cap))


def resolve_overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, order: str, dummy: str) -> DataFrame:
    """A schedule without overlaps: of equal starts the first non-dummy by `order` stays, and an end goes no further than the next start."""
    w = W.partitionBy(*keys, start).orderBy(F.col(dummy).cast("int"), order)
    one = df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return one.withColumn("end", F.least(F.col(end), F.lead(start).over(W.partitionBy(*keys).orderBy(start))))


def sessions(df: DataFrame, keys: Sequence[str], order: str, at: Column, gap: int, tie: str | None = None) -> DataFrame:
    """df with session: a new one begins after more than `gap` without a row."""
    w = W.partitionBy(*keys).orderBy(order, *([tie] if tie else []))
    new = F.when(at - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def unwrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, modulo: int) -> DataFrame:
    """df with whole: a counter that starts again at 0, made to go on: `modulo` is added at each fall."""
    w = W.partitionBy(*keys).orderBy(*order)
    fell = F.when(F.col(counter) < F.lag(counter).over(w), modulo).otherwise(0)
    return df.withColumn("_fell", fell).withColumn("whole", F.col(counter) + F.sum("_fell").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_fell")


def rolling_vote(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 50) -> DataFrame:
    """df with voted: the commonest value of the last `rows` rows, ties to the smallest."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    seen = F.collect_list(value).over(w)
    # Of the sorted values, the one whose run is longest; the first such is the smallest.
    best = F.expr(f"aggregate(array_sort(_seen), named_struct('v', CAST(NULL AS {df.schema[value].dataType.simpleString()}), 'n', 0, 'c', CAST(NULL AS {df.schema[value].dataType.simpleString()}), 'k', 0), (a, x) -> CASE WHEN a.c <=> x AND a.k + 1 > a.n THEN named_struct('v', x, 'n', a.k + 1, 'c', x, 'k', a.k + 1) WHEN a.c <=> x THEN named_struct('v', a.v, 'n', a.n, 'c', x, 'k', a.k + 1) WHEN a.n = 0 THEN named_struct('v', x, 'n', 1, 'c', x, 'k', 1) ELSE named_struct('v', a.v, 'n', a.n, 'c', x, 'k', 1) END, a -> a.v)")
    return df.withColumn("_seen", seen).withColumn("voted", best).drop("_seen")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tolerance: int) -> DataFrame:
    """left with value and distance of the nearest right row by `at` (a number), if within `tolerance`; ties to the earlier.

    left and right are united and sorted once by key: last value before, first value after.
    """
    ours = left.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("long").alias("_t"), F.struct(*left.columns).alias("_row"))
    theirs = right.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v"), F.col(at).cast("long").alias("_t"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"))
    # Both frames begin with the key and grow, one in either direction: a frame that shrinks would be summed up anew for each row.
    upto, since = (W.partitionBy(*keys).orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.col("_at"), F.desc("_at")))
    pair = F.when(F.col("_t").isNotNull(), F.struct("_t", "_v"))
    both = ours.unionByName(theirs).withColumn("_b", F.last(pair, ignorenulls=True).over(upto)).withColumn("_a", F.last(pair, ignorenulls=True).over(since)).filter(F.col("_row").isNotNull())
    before, after = F.col("_at") - F.col("_b._t"), F.col("_a._t") - F.col("_at")
    earlier = F.when(after.isNull() | (before <= after), True).otherwise(False) & before.isNotNull()
    distance = F.when(earlier, before).otherwise(after)
    found = F.when(earlier, F.col("_b._v")).otherwise(F.col("_a._v"))
    near = distance <= tolerance
    return both.select("_row.*", F.when(near, found).alias(value), F.when(near, distance).alias("distance"))


def in_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int, most: int = 1000) -> DataFrame:
    """points joined with the spans that hold them (start <= at < end), by equal buckets of `bucket` units: no nested loop.

    A span is listed in each bucket it touches, so `bucket` should be about the usual length of a span. Points at one place have the same
    spans, so up to about `most` of them are joined as one row and taken apart afterwards: fewer rows are compared, and what a
    span is joined with comes in runs that are small in a file.
    """
    rest = [c for c in points.columns if c not in (*keys, at)]
    held = points.select(*keys, at, F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_row"))
    # Places with many points are cut by a hash, so that no row has them all.
    many = held.groupBy(*keys, at).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    part = F.pmod(F.xxhash64("_row"), F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)))
    sets = held.join(many, [*keys, at], "left").groupBy(*keys, at, part.alias("_part")).agg(F.collect_list("_row").alias("_rows"))
    listed = spans.filter(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    met = sets.withColumn("_bucket", F.floor(F.col(at) / bucket)).join(listed, [*keys, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    ours = [F.col(c) if c not in rest else F.col(f"_row.`{c}`").alias(c) for c in points.columns]
    return met.withColumn("_row", F.explode("_rows")).select(*ours, *[c for c in spans.columns if c not in keys])


def tumbling(df: DataFrame, at: str, width: str, **aggregates: Column) -> DataFrame:
    """window_start and the aggregates of each stretch of `width`."""
    return df.groupBy(F.window(at, width).alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("_w.start").alias("window_start"), *aggregates)


def sliding_best(df: DataFrame, at: str, width: str, step: str, value: str) -> DataFrame:
    """window_start, value, votes: the commonest value of each sliding window, ties to the smallest."""
    from .votes import vote

    held = df.select(F.window(at, width, step).alias("_w"), value).select(F.col("_w.start").alias("window_start"), value)
    return vote(held, ["window_start"], value).drop("total")


def second_sight(df: DataFrame, keys: Sequence[str], order: str, content: str) -> DataFrame:
    """keys, content, order: new content of a key is taken when it comes for the second time, so that what was read wrong once never is; at that sighting."""
    n = F.row_number().over(W.partitionBy(*keys, content).orderBy(order))
    return df.withColumn("_n", n).filter("_n = 2").select(*keys, content, order)


def erased(df: DataFrame, keys: Sequence[str], copy: str, row: str, text: str, flag: str, percent: int = 50) -> DataFrame:
    """keys, copy, replaces: whether a copy takes the place of what was there (its erase flag is set and fewer than `percent` of its rows are as in the copy before it) or is laid over it. The first copy replaces."""
    copies = df.groupBy(*keys, copy).agg(F.max(flag).alias("_flag"), F.count("*").alias("_rows")).withColumn("_before", F.lag(copy).over(W.partitionBy(*keys).orderBy(copy)))
    old = df.select(*keys, F.col(copy).alias("_before"), row, F.col(text).alias("_old"))
    same = df.join(copies.select(*keys, copy, "_before"), [*keys, copy]).join(old, [*keys, "_before", row]).filter(F.col(text) == F.col("_old")).groupBy(*keys, copy).agg(F.count("*").alias("_same"))
    held = copies.join(same, [*keys, copy], "left")
    few = F.coalesce("_same", F.lit(0)) * 100 < F.col("_rows") * percent
    return held.select(*keys, copy, (F.col("_before").isNull() | (F.col("_flag") & few)).alias("replaces"))
