"""Near-equal copies: pairs by blocking, merging of near names, overlaps by grams, plausibility of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.operators import overlaps


def distance(a: Column, b: Column, width: int) -> Column:
    """Places at which two texts differ, both padded with spaces to `width`."""
    chars = lambda c: F.split(F.rpad(c, width, " "), "")
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def block_pairs(rows: DataFrame, key: str, text: str, *, width: int = 40, most: int = 3) -> DataFrame:
    """a, b (a < b), distance of all rows whose texts differ in at most `most` of `width` places.

    Of two such texts the longer, without the spaces at its end, has all differences inside it. Cut in most + 1 blocks by its length
    (rounded up to a multiple of most + 1), the two share one whole block, by the pigeonhole. So a text is listed with the blocks of
    its own length, and as the shorter one with those of all lengths above; equal blocks of one length are candidates. The longer's
    blocks hold text, so that spaces that fill texts up bring none together. Equal texts are one class that is paired once, and its
    members are listed under it: see `classes`.
    """
    padded = F.rpad(F.substring(text, 1, width), width, " ")
    one = rows.filter(F.col(text).isNotNull()).select(padded.alias("_t"), F.col(key)).groupBy("_t").agg(F.min(key).alias("_k")).withColumn("_n", F.greatest(F.ceil(F.length(F.rtrim("_t")) / (most + 1)), F.lit(1)).cast("int"))
    blocks = lambda size: F.array(*[F.struct(size.alias("l"), F.lit(i).alias("i"), F.substring(F.col("_t"), size * i + 1, size).alias("s")) for i in range(most + 1)])
    lengths = F.sequence("_n", F.lit(-(-width // (most + 1))))  # of a block
    own = one.select(F.col("_k").alias("_ka"), F.col("_t").alias("_ta"), F.explode(blocks(F.col("_n"))).alias("_b"))
    guests = one.select(F.col("_k").alias("_kb"), F.col("_t").alias("_tb"), F.explode(F.flatten(F.transform(lengths, blocks))).alias("_b"))
    pairs = own.join(guests, "_b").filter("_ka <> _kb").select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), F.least("_ta", "_tb").alias("_ta"), F.greatest("_ta", "_tb").alias("_tb"))
    return pairs.distinct().withColumn("distance", distance(F.col("_ta"), F.col("_tb"), width)).filter(F.col("distance") <= most).select("a", "b", "distance")


def classes(rows: DataFrame, key: str, text: str, width: int = 40) -> DataFrame:
    """key, class: the least key with the same text."""
    padded = F.rpad(F.substring(text, 1, width), width, " ")
    return rows.filter(F.col(text).isNotNull()).select(key, F.min(key).over(W.partitionBy(padded)).alias("class"))


def masks(text: Column) -> Column:
    """The text with each character in turn replaced by a mark: equal masks mean at most that character differs."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.lit("\0"), F.substring(text, i + 1, F.length(text))))


def merge_near_names(names: DataFrame, name: str, ratio: int = 3) -> DataFrame:
    """name, n, merged: a name becomes the commonest other name that differs in one character and came `ratio` times as often (ties to the smallest).

    Names that differ in a digit are different names.
    """
    counts = names.filter(F.length(name) > 0).groupBy(name).agg(F.count("*").alias("n"))
    listed = counts.select(name, "n", F.posexplode(masks(F.col(name))).alias("_i", "_m"))
    other = listed.select(F.col(name).alias("_other"), F.col("n").alias("_k"), "_i", "_m")
    at = lambda c: F.substring(F.col(c), F.col("_i") + 1, F.lit(1))
    near = listed.join(other, ["_i", "_m"]).filter((F.col("_k") >= F.col("n") * ratio) & (F.col(name) != F.col("_other"))).filter(~at(name).rlike("[0-9]") & ~at("_other").rlike("[0-9]"))
    best = near.groupBy(name).agg(F.min_by("_other", F.struct(-F.col("_k"), "_other")).alias("_to"))
    return counts.join(best, name, "left").select(name, "n", F.coalesce("_to", name).alias("merged"))


def gram_overlaps(texts: DataFrame, key: str, text: str, *, gram: int = 8, share: int = 12) -> DataFrame:
    """a, b, at, overlap: text b begins inside text a at `at` and agrees with it to its end, but for one place in `share`; the longest overlap of each pair.

    The first `gram` characters of b are looked for at all places of a. The pairs that one gram brings together grow with the square
    of the texts, and few of them are more alike; so they are compared in arrays, eight places at once, and only overlaps become rows.
    """
    return overlaps.overlaps(texts, key, text, gram, share)


def snap(readings: DataFrame, keys: Sequence[str], value: str, *, percent: int = 3, bits: int = 2) -> DataFrame:
    """readings with snapped: a value that isn't one of its key's dominant ones (at least `percent` of all) becomes the nearest of them, by at most `bits` bits; else null."""
    counts = readings.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = counts.join(total, list(keys)).withColumn("_big", F.col("_n") * 100 >= F.col("_total") * percent)
    big = ranked.filter("_big").groupBy(*keys).agg(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(value).alias("v"))).alias("_list"))  # at most 100 / percent a key
    near = F.array_sort(F.transform(F.filter("_list", lambda x: F.bit_count(x["v"].bitwiseXOR(F.col(value))) <= bits), lambda x: F.struct(F.bit_count(x["v"].bitwiseXOR(F.col(value))).alias("d"), (-x["n"]).alias("n"), x["v"].alias("v"))))
    to = ranked.join(big, list(keys), "left").select(*keys, value, F.get(near, F.lit(0))["v"].alias("snapped"))
    return readings.join(to, [*keys, value], "left")


def trigrams(texts: DataFrame, text: str) -> DataFrame:
    """gram, n over the words of all texts, each word between two spaces."""
    words = texts.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("_c"))
    return words.select("_c", F.explode(_grams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.sum("_c").alias("n"))


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def plausibility(words: DataFrame, word: str, counts: DataFrame, smoothing: float = 0.05) -> DataFrame:
    """word, score: the mean log frequency of its trigrams, each count raised by `smoothing`."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    each = words.filter(F.length(word) > 0).select(word).distinct().withColumn("gram", F.explode(_grams(F.lower(word))))
    return each.join(counts, "gram", "left").groupBy(word).agg(F.avg(F.log((F.coalesce("n", F.lit(0)) + smoothing) / (total + smoothing))).alias("score"))


def restore_words(words: DataFrame, word: str, *, often: int = 5, ratio: int = 10) -> DataFrame:
    """word, n, restored: a rare word becomes the one frequent word that differs in a single letter; unchanged where there are none or several."""
    counts = words.filter(F.length(word) > 2).groupBy(word).agg(F.count("*").alias("n"))
    listed = counts.select(word, "n", F.explode(masks(F.col(word))).alias("_m"))
    good = listed.filter(F.col("n") >= often).select(F.col(word).alias("_good"), F.col("n").alias("_k"), "_m")
    bad = listed.filter(F.col("n") < often)
    met = bad.join(good, "_m").filter((F.col("_k") >= F.col("n") * ratio)).groupBy(word).agg(F.min("_good").alias("_a"), F.max("_good").alias("_b"))
    return counts.join(met, word, "left").select(word, "n", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col(word)).alias("restored"))


def known_words(words: DataFrame, word: str, stems: DataFrame, stem: str, endings: Sequence[str]) -> DataFrame:
    """word, known: whether a word is a stem of the dictionary with one of the endings; words are listed under each stem they may have, so the join is by equality."""
    once = words.filter(F.length(word) > 0).select(word).distinct()
    cut = F.array_compact(F.array(*[F.when(F.col(word).endswith(e) & (F.length(word) > len(e)), F.expr(f"left(`{word}`, length(`{word}`) - {len(e)})")) for e in endings]))
    found = once.select(word, F.explode(cut).alias("_stem")).join(stems.select(F.col(stem).alias("_stem")).distinct(), "_stem", "left_semi").select(word).distinct().withColumn("_known", F.lit(True))
    return once.join(found, word, "left").select(word, F.coalesce("_known", F.lit(False)).alias("known"))
