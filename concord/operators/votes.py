"""Votes: from many copies of a value to one, with a stated rule for ties.

All votes are two aggregations (count by value, then the best value by key), so a hot key is summed up on the map side and no
task holds a key's copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIES = ("smallest", "largest", "first", "newest")


def vote(df: DataFrame, keys: Sequence[str], value: str, *, weight: Column | None = None, tie: str = "smallest", order: str | None = None, prefer: Column | None = None) -> DataFrame:
    """keys, value, votes, total: the value with the most votes (or weight) of each key.

    Ties go to the smallest or largest value, or to the one seen first or newest by `order`. prefer: values for which it is true
    go before all others, whatever their votes. Null values don't vote; a key with none has no row.
    """
    if tie not in TIES or (tie in ("first", "newest")) != (order is not None):
        raise ValueError("tie is smallest, largest, or, with an order, first or newest")
    votes = F.sum(weight) if weight is not None else F.count("*")
    seen = [F.min(order).alias("_seen")] if tie == "first" else [F.max(order).alias("_seen")] if tie == "newest" else []
    liked = F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(True)
    by = df.filter(F.col(value).isNotNull()).withColumn("_liked", liked).groupBy(*keys, value, "_liked").agg(votes.alias("votes"), *seen)
    if tie in ("smallest", "first"):
        rank = F.struct(~F.col("_liked"), -F.col("votes"), *(["_seen"] if seen else []), value)
        best = F.min_by(F.struct(value, "votes"), rank)
    else:
        rank = F.struct("_liked", "votes", *(["_seen"] if seen else []), value)
        best = F.max_by(F.struct(value, "votes"), rank)
    return by.groupBy(*keys).agg(best.alias("_best"), F.sum("votes").alias("total")).select(*keys, F.col(f"_best.{value}").alias(value), F.col("_best.votes").alias("votes"), "total")


def positional_vote(df: DataFrame, keys: Sequence[str], text: str, *, width: int | None = None) -> DataFrame:
    """keys, text, copies: character by character the commonest of all copies, ties to the smallest; a copy that has ended doesn't vote."""
    chars = F.split(F.substring(text, 1, width) if width else F.col(text), "")
    each = df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(chars).alias("pos", "char"))
    won = vote(each.filter("char <> ''"), [*keys, "pos"], "char")
    return won.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("text"), F.max("total").alias("copies"))


def soft_vote(df: DataFrame, keys: Sequence[str], soft: str) -> DataFrame:
    """keys, total, bit: the sign of the sum of signed confidences; 0 where they cancel out."""
    return df.groupBy(*keys).agg(F.sum(soft).alias("total")).withColumn("bit", F.signum("total").cast("int"))


def bit_majority(df: DataFrame, keys: Sequence[str], word: str, bits: int) -> DataFrame:
    """keys, word: every bit set that more than half of the copies have set."""
    sums = [F.sum(F.shiftright(word, b).bitwiseAND(F.lit(1))).alias(f"_b{b}") for b in range(bits)]
    found = df.groupBy(*keys).agg(F.count(word).alias("_n"), *sums)
    value = F.lit(0).cast("long")
    for b in range(bits):
        value = value + F.when(F.col(f"_b{b}") * 2 > F.col("_n"), F.lit(1 << b).cast("long")).otherwise(0)
    return found.select(*keys, value.alias("word"))


def quorum(groups: DataFrame, page: Sequence[str], group: str, copies: str, least: int = 3) -> DataFrame:
    """Groups with at least `least` copies; of a page without any, its largest (ties to the smallest group)."""
    w = W.partitionBy(*page)
    best = F.row_number().over(w.orderBy(F.desc(copies), group))
    return groups.withColumn("_any", F.max(copies).over(w) >= least).withColumn("_rank", best).filter(((F.col(copies) >= least)) | (~F.col("_any") & (F.col("_rank") == 1))).drop("_any", "_rank")


def pick(df: DataFrame, keys: Sequence[str], value: str, *, least: int = 2, percent: int = 60) -> DataFrame:
    """The vote of each key where it has at least `least` copies and `percent` of all; other keys have no row."""
    return vote(df, keys, value).filter((F.col("votes") >= least) & (F.col("votes") * 100 >= F.col("total") * percent))


def rare_filter(df: DataFrame, keys: Sequence[str], value: str, *, least: int = 3, ratio: int = 10) -> DataFrame:
    """keys, value, n: the values of a key that came at least `least` times and a `ratio`-th as often as its commonest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = F.max("n").over(W.partitionBy(*keys)) if keys else F.lit(counts.agg(F.max("n")).first()[0])
    return counts.withColumn("_top", top).filter((F.col("n") >= least) & (F.col("n") * ratio >= F.col("_top"))).drop("_top")


def foreign_rows(rows: DataFrame, page: str, row: str, versions: str | None = None, ratio: int = 3, clean: bool = False) -> DataFrame:
    """page, row, n: rows kept where they came more than a `ratio`-th as often as on the page that has them most, or in two versions or more of the page's own. A clean stream keeps all."""
    own = F.countDistinct(versions) if versions else F.lit(1)
    counts = rows.groupBy(page, row).agg(F.count("*").alias("n"), own.alias("_own"))
    if clean:
        return counts.select(page, row, "n")
    top = counts.groupBy(row).agg(F.max("n").alias("_top"))
    return counts.join(top, row).filter((F.col("n") * ratio > F.col("_top")) | (F.col("_own") >= 2)).select(page, row, "n")


def majority_kind(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """The rows of df whose kind is the commonest of their key (ties to the smallest)."""
    return df.join(vote(df, keys, kind).select(*keys, F.col(kind).alias("_kind")), list(keys)).filter(F.col(kind) == F.col("_kind")).drop("_kind")


def consensus(df: DataFrame, keys: Sequence[str], value: str, evidence: str, *, least: int = 3, lead: int = 2, distinct: int = 3) -> DataFrame:
    """keys, value, n: the commonest value of a key if it has `least` copies, `lead` times the second's, from `distinct` different pieces of evidence."""
    by = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.countDistinct(evidence).alias("_kinds"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), F.desc(value), F.desc("_kinds")))
    two = by.withColumn("_place", place).filter(F.col("_place") <= 2)
    first = F.max(F.when(F.col("_place") == 1, F.struct("n", F.col(value).alias("v"), F.col("_kinds").alias("kinds")))).alias("_a")
    top = two.groupBy(*keys).agg(first, F.max(F.when(F.col("_place") == 2, F.col("n"))).alias("_second"))
    return top.filter((F.col("_a.n") >= least) & (F.col("_a.n") >= F.coalesce("_second", F.lit(0)) * lead) & (F.col("_a.kinds") >= distinct)).select(*keys, F.col("_a.v").alias(value), F.col("_a.n").alias("n"))


def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, entropy: Shannon's, in bits, of the values of each key."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # sum(-p log2 p) = log2(N) - sum(n log2 n) / N needs one pass over the counts.
    return by.groupBy(*keys).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias("entropy"))


def common_words(pages: DataFrame, page: str, text: str, percent: int = 60) -> DataFrame:
    """word, pages: words on at least `percent` of all pages."""
    words = pages.select(page, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("word")).filter("word <> ''")
    n = pages.agg(F.countDistinct(page)).first()[0]
    return words.groupBy("word").agg(F.countDistinct(page).alias("pages")).filter(F.col("pages") * 100 >= n * percent)


def header_shape(df: DataFrame, keys: Sequence[str], header: str) -> DataFrame:
    """keys, header, n: the commonest real text among those of the commonest shape (digits as #) of each key."""
    shaped = df.withColumn("_shape", F.regexp_replace(header, "[0-9]", "#"))
    shape = vote(shaped, keys, "_shape").select(*keys, "_shape")
    return vote(shaped.join(shape, [*keys, "_shape"]), keys, header).select(*keys, header, F.col("votes").alias("n"))


def distant_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, *, share: float = 0.2, least: int = 10) -> DataFrame:
    """keys, slope: the median slope between points of a key that are more than `share` of its range apart; 1 where there are at most `least` such pairs.

    Every point is paired with one other, by a permutation-like step through the points in order of x, so pairs grow with points.
    """
    w = W.partitionBy(*keys)
    ranked = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).withColumn("_i", F.row_number().over(w.orderBy("_x", "_y"))).withColumn("_n", F.count("*").over(w)).withColumn("_wide", F.max("_x").over(w) - F.min("_x").over(w))
    one = ranked.withColumn("_j", (F.col("_i") * 7919 + 104729) % F.col("_n") + 1)
    two = ranked.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_u"), F.col("_y").alias("_v"))
    far = one.join(two, [*keys, "_j"]).filter(F.abs(F.col("_u") - F.col("_x")) > share * F.col("_wide"))
    found = far.groupBy(*keys).agg(F.count("*").alias("_k"), F.median((F.col("_v") - F.col("_y")) / (F.col("_u") - F.col("_x"))).alias("_s"))
    return df.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.when(F.col("_k") > least, F.col("_s")).otherwise(F.lit(1.0)).alias("slope"))


def robust_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, limit: float) -> DataFrame:
    """keys, slope, intercept, n: least squares over the points within `limit` of the line with the median slope of distant points and the median of what that leaves."""
    steep = df.join(distant_slope(df, keys, x, y).withColumnRenamed("slope", "_s"), list(keys)).withColumn("_r", F.col(y) - F.col("_s") * F.col(x))
    middle = steep.groupBy(*keys).agg(F.median("_r").alias("_m"))
    near = steep.join(middle, list(keys)).filter(F.abs(F.col("_r") - F.col("_m")) <= limit)
    return near.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def vote_or_whole(df: DataFrame, keys: Sequence[str], slot: str, value: str, copy: str, whole: str) -> DataFrame:
    """keys, slot, value, from_copy: a block as the first copy whose check is right has it (`whole` is true in all its slots); else slot by slot the commonest value, ties to the smallest."""
    copies = df.groupBy(*keys, copy).agg(F.min(F.col(whole).cast("int")).alias("_ok"))
    first = copies.filter("_ok = 1").groupBy(*keys).agg(F.min(copy).alias("_first"))
    marked = df.join(first, list(keys), "left")
    taken = marked.filter(F.col("_first").isNotNull() & (F.col(copy) == F.col("_first"))).groupBy(*keys, slot).agg(F.min(value).alias(value)).withColumn("from_copy", F.lit(True))
    voted = vote(marked.filter(F.col("_first").isNull()), [*keys, slot], value).select(*keys, slot, value, F.lit(False).alias("from_copy"))
    return taken.unionByName(voted)
