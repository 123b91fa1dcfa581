"""Relations between tables of records: lookups with fallbacks, merges with precedence, folding of damaged keys, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.plans.work import cut, cut_small, drop


def lookup(facts: DataFrame, names: DataFrame, key: str, name: str, default: Column | None = None) -> DataFrame:
    """facts with name from names (one row a key); `#` and the key where there is none. Spark broadcasts names if they are small."""
    other = default if default is not None else F.concat(F.lit("#"), F.col(key).cast("string"))
    return facts.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(name, F.coalesce("_name", other)).drop("_name")


def fallback(facts: DataFrame, first: DataFrame, second: DataFrame, key: str, name: str) -> DataFrame:
    """facts with name from the first table, or else from the second."""
    found = facts.join(first.select(key, F.col(name).alias("_first")), key, "left").join(second.select(key, F.col(name).alias("_second")), key, "left")
    return found.withColumn(name, F.coalesce("_first", "_second")).drop("_first", "_second")


def prefix_match(left: DataFrame, right: DataFrame, text: str, prefix: str, least: int = 1) -> DataFrame:
    """left joined with the right rows whose prefix its text begins with, by equality: a text is listed under its beginnings of the lengths that prefixes have. Repeated rows stay."""
    known = right.filter(F.length(prefix) >= least)
    lengths = sorted(r[0] for r in known.select(F.length(prefix)).distinct().collect())  # no more than the longest prefix has characters
    beginnings = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(text))
    keyed = left.withColumn("_key", F.explode(F.transform(beginnings, lambda n: F.substring(F.col(text), F.lit(1), n))))
    return keyed.join(known.withColumn("_key", F.col(prefix)), "_key").drop("_key")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], better: Column) -> DataFrame:
    """One row a key with outcome (added, kept, replaced): a new row replaces an old one where `better` holds over the structs o and n.

    Both tables have the same columns, and one row a key.
    """
    rest = [c for c in old.columns if c not in keys]
    o, n = old.select(*keys, F.struct(*rest).alias("o")), new.select(*keys, F.struct(*rest).alias("n"))
    both = o.join(n, list(keys), "full_outer")
    take = F.col("o").isNull() | (F.col("n").isNotNull() & F.coalesce(better, F.lit(False)))
    outcome = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "kept").when(take, "replaced").otherwise("kept")
    return both.select(*keys, F.when(take, F.col("n")).otherwise(F.col("o")).alias("_row"), outcome.alias("outcome")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "outcome")


#: When a new row replaces an old one.
def better_name(name: str = "name", verified: str = "verified") -> Column:
    """A channel: the old name empty and the new one not, or the old unverified and the new verified."""
    empty = lambda r: F.coalesce(F.col(f"{r}.{name}"), F.lit("")) == ""
    return (empty("o") & ~empty("n")) | (~F.col(f"o.{verified}") & F.col(f"n.{verified}"))


def better_text(text: str = "text", partial: str = "partial") -> Column:
    """A programme or description: the old text empty and the new one not, or the old partial and the new complete."""
    empty = lambda r: F.coalesce(F.col(f"{r}.{text}"), F.lit("")) == ""
    return (empty("o") & ~empty("n")) | (F.col(f"o.{partial}") & ~F.col(f"n.{partial}"))


def better_list(version: str = "version", verified: str = "verified") -> Column:
    """A show list: another version (or the old unverified and the new verified), and not a verified one by an unverified."""
    same = (F.col(f"o.{version}") == F.col(f"n.{version}")) & (F.col(f"o.{verified}") | ~F.col(f"n.{verified}"))
    return ~same & (F.col(f"n.{verified}") | ~F.col(f"o.{verified}"))


def merge_counters(parts: Sequence[DataFrame], keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Counters of several recordings added up: partial counts, then their sum."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def best_copy(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """keys, values, copies: the row with the highest rank of each key, ties to the greatest values."""
    return df.groupBy(*keys).agg(F.max(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *values)).alias("_m"), F.count("*").alias("copies")).select(*keys, *[F.col(f"_m.{v}").alias(v) for v in values], "copies")


def fill_from_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """A full outer merge: left's value, or the one of the right row of the key that is nearest by `at` (ties to the earlier); keys only right has come from its earliest. Equal rows of left are one."""
    from concord.operators.timeline import nearest

    others = right.select(*keys, F.col(at), F.col(value).alias("_v"))
    ours = nearest(left.select(*keys, at, value).distinct(), others, keys, at, "_v", 2**62).select(*keys, at, F.coalesce(value, "_v").alias(value))
    rest = others.join(left.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(F.min_by("_v", at).alias(value))
    return ours.union(rest.select(*keys, F.lit(None).cast(left.schema[at].dataType).alias(at), value))


def fold_one_digit(keys: DataFrame, key: str, attested: Column) -> DataFrame:
    """key, folded: an unattested key becomes the only attested key that differs in one character; null where there are none or several.

    Both sides are listed under each of their masks (one character out), so the join is by equality.
    """
    masks = F.explode(F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substring(F.col(key), F.lit(1), i - 1), F.lit("\0"), F.substring(F.col(key), i + 1, F.length(key))))).alias("_mask")
    one = keys.groupBy(key).agg(F.max(attested).alias("_good"))
    good = one.filter("_good").select(F.col(key).alias("_to"), masks)
    lost = one.filter("NOT _good")
    # A mask may hold many good keys; two are enough to know that it is ambiguous.
    few = good.groupBy("_mask").agg(F.min("_to").alias("_least"), F.max("_to").alias("_most"))
    found = lost.select(key, masks).join(few, "_mask").groupBy(key).agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    folded = F.when(F.col("_least") == F.col("_most"), F.col("_least"))
    return lost.join(found, key, "left").select(key, folded.alias("folded")).union(one.filter("_good").select(key, F.col(key).alias("folded")))


def missing(have: DataFrame, keys: Sequence[str], number: str, expected: str) -> DataFrame:
    """keys, expected, had, missing (sorted numbers) of each key; numbers are 1 to expected."""
    one = have.groupBy(*keys).agg(F.max(expected).alias("expected"), F.collect_set(number).alias("_had"))
    return one.select(*keys, "expected", F.size("_had").cast("long").alias("had"), F.array_sort(F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("expected").cast("long"), F.lit(1).cast("long"))), F.col("_had").cast("array<long>"))).alias("missing"))


def only_candidate(clues: DataFrame, key: str, clue: str, candidate: str) -> DataFrame:
    """key, candidate: the one candidate that all clues of a key allow; keys with none or several have no row."""
    total = clues.groupBy(key).agg(F.countDistinct(clue).alias("_clues"))
    full = clues.groupBy(key, candidate).agg(F.countDistinct(clue).alias("_n")).join(total, key).filter("_n = _clues")
    return full.groupBy(key).agg(F.count("*").alias("_k"), F.min(candidate).alias(candidate)).filter("_k = 1").drop("_k")


def chain(links: DataFrame, key: str, following: str, start: DataFrame) -> DataFrame:
    """start key, key, step: the records that `following` leads to, each chain to its end.

    Jumps are doubled: a round joins what was reached so far with jumps as long as that, so a chain of n records takes log2(n)
    rounds, each a table in the shared folder. A chain that comes back to itself has no end and is refused.
    """
    jump = cut_small(links.filter(F.col(following).isNotNull()).select(F.col(key).alias("_from"), F.col(following).alias("_to")), "jumps")
    records, length = jump.select("_from").union(jump.select("_to")).distinct().count(), 1
    reached = cut_small(start.select(F.col(key).alias("start"), F.col(key), F.lit(0).alias("step")), "reached")
    while True:
        # What was reached has all steps below `length`, and a jump is so many steps.
        more = cut_small(reached.join(jump, F.col(key) == F.col("_from")).select("start", F.col("_to").alias(key), (F.col("step") + length).alias("step")), "reached")
        if more.isEmpty():
            return reached
        if length >= records:
            raise ValueError("a chain leads back to itself")
        new = cut_small(reached.union(more), "reached")
        twice = cut_small(jump.join(jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_next")), "_to").select("_from", F.col("_next").alias("_to")), "jumps")
        for df in (reached, more, jump):
            drop(df)
        reached, jump, length = new, twice, 2 * length


def united(views: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All tables as one wide one, with the service each row is from; columns that a table lacks are null."""
    every = None
    for service, df in views:
        part = df.withColumn("service", F.lit(service))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return every


def stretches(text: Column, size: int, more: int) -> Column:
    """An array of the stretches of `size` characters of a text, each with `more` of what follows: places within one are found in steps that don't grow with the text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size + more)))


def not_contained(loose: DataFrame, text: str, known: DataFrame, whole: str, gram: int = 8, size: int = 1000) -> DataFrame:
    """The loose texts that no known text contains, found by the first `gram` characters and then compared; shorter texts stay.

    What is listed of the known texts are hashes of their grams with a key of the text; only texts with a gram that begins a loose
    text are looked at whole.
    """
    keyed = known.filter(F.length(whole) >= gram).select(F.col(whole).alias("_whole"), F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit(1), whole).alias("_k2"))
    part = keyed.select("_k1", "_k2", F.explode_outer(stretches(F.col("_whole"), size, gram - 1)).alias("_p"))
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_p") - gram + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col("_p"), i, F.lit(gram))))
    needles = loose.filter(F.length(text) >= gram).select(F.col(text).alias("_text")).distinct().withColumn("_gram", F.xxhash64(F.substring("_text", 1, gram)))
    met = part.select("_k1", "_k2", F.explode_outer(places).alias("_gram")).join(needles, "_gram").select("_k1", "_k2", "_text").distinct()
    texts = keyed.join(met.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.any_value("_whole").alias("_whole"))
    held = texts.join(met, ["_k1", "_k2"]).filter(F.col("_whole").contains(F.col("_text"))).select(F.col("_text").alias(text)).distinct()
    return loose.join(held, text, "left_anti")


def rank_in_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with rank: its place in the key, from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def upsert_files(files: DataFrame, keys: Sequence[str], complete: str, size: str, order: str) -> DataFrame:
    """keys, complete, size, at (order of the one that stays), copies (complete ones): a complete file replaces a part, a longer part a shorter one; of equal ones the first stays."""
    key = F.struct(F.col(complete).cast("int").alias("c"), F.when(F.col(complete), 0).otherwise(F.col(size)).alias("s"), (-F.col(order)).alias("o"), F.col(size).alias("z"))
    best = files.groupBy(*keys).agg(F.max(key).alias("_m"), F.count_if(complete).alias("copies"))
    return best.select(*keys, (F.col("_m.c") == 1).alias("complete"), F.col("_m.z").alias("size"), (-F.col("_m.o")).alias("at"), "copies")


def chain_pieces(pieces: DataFrame, key: str, text: str, overlap: int, within: int | None = None) -> DataFrame:
    """start, text, pieces: pieces of a repeated file put together: a piece goes on with the one whose first `overlap` characters are its last, if that is the only one and the only one before it; each chain is one text.

    within: keys are in the order of sending, and a piece goes on only with one whose first copy has a key larger by at most that; so ends
    that are equal by chance, as some are among millions, are told apart by where they were sent.
    """
    long = pieces.filter(F.length(text) > overlap).groupBy(text).agg(F.min(key).alias(key))
    tails = long.select(F.col(key).alias("_from"), F.expr(f"right(`{text}`, {overlap})").alias("_g"))
    heads = long.select(F.col(key).alias("_to"), F.expr(f"left(`{text}`, {overlap})").alias("_g"))
    # What several pieces have, or could go on with, says nothing.
    one = lambda df, by, c: df.groupBy(by).agg(F.min(c).alias(c), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    if within is None:
        met = one(tails, "_g", "_from").join(one(heads, "_g", "_to"), "_g").filter("_from <> _to")
    else:
        # By stretches of keys, so that an end which very many pieces have meets only those sent near it.
        stretch = lambda c: F.floor(F.col(c) / (within + 1))
        ahead = tails.withColumn("_s", F.explode(F.array(stretch("_from"), stretch("_from") + 1)))
        near = ahead.join(heads.withColumn("_s", stretch("_to")), ["_g", "_s"]).filter((F.col("_to") > F.col("_from")) & (F.col("_to") - F.col("_from") <= within))
        near = cut(near.select("_from", "_to"), "near")
        met = one(near, "_from", "_to").join(one(near, "_to", "_from"), ["_from", "_to"])
    links = met.select(F.col("_from").alias(key), F.col("_to").alias("_next"))
    links = cut_small(links, "links")
    starts = long.select(key).join(links.select(F.col("_next").alias(key)), key, "left_anti")
    reached = chain(links, key, "_next", starts).join(long, key)
    body = F.when(F.col("step") == 0, F.col(text)).otherwise(F.expr(f"substring(`{text}`, {overlap + 1})"))
    parts = F.array_sort(F.collect_list(F.struct("step", body.alias("t"))))
    return reached.groupBy("start").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.count("*").alias("pieces"))
