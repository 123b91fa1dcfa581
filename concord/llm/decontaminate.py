"""Benchmark decontamination [native]: a prefix-filtered join of document windows with item windows.

A window is `window` consecutive words of an item, or the whole of a shorter item. Its shingles are its runs of SHINGLE words (a
window of fewer words is one shingle). Every document that contains a window contains each of its shingles, so any of them is a
necessary prefix: shingles are ordered by rarity, their count in all documents, and the rarest of each window is joined. Its place
in the window then bounds where the window would have to begin and whether the document has room for it. What is left is verified:
each of the window's shingles has to be at its place, so every word is compared, most of them in three shingles.

Everything is DataFrame operations, and one plan at every size. Texts are read and split once: each place becomes the 64-bit hash
of the shingle that begins there, which is joined with the hashes of the items' shingles. Places with one of those, few next to
all words, are kept in a table; counts, candidates and hits come from it, and texts aren't shuffled. A false hit takes a shingle
that differs and has the same hash, beside others that are right. Arrays are exploded by the outer forms: for the others Spark
adds a filter on the array's size, and pushes it, with the splitting of the text, into the function of each element.

Defined results: null or wordless texts have no words and no hits; a document with fewer words than a window cannot hold it;
identical texts are matched once and get the same result, also under the same doc_id; an item with a null id marks words but is
not listed; repeated items count once; an empty benchmark leaves every document clean; an empty table gives no rows; other columns
are left alone, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut, cut_small, text_key

#: Fixed value: what is between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Words of a shingle.
SHINGLE = 3


def words_of(text: Column) -> Column:
    """The words of a text. By splitting: extracting all matches copies the text for each of them."""
    gaps = "".join(c for c in map(chr, range(0x80)) if re.fullmatch(GAP, c))
    inner = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(gaps))
    return F.when(inner != "", F.split(inner, f"{GAP}+")).otherwise(F.array().cast("array<string>"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item_id, w (the words joined by a space), len: the windows of all items."""
    words = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words_of(F.col(f"`{text}`")).alias("words"))
    starts = F.expr(f"sequence(1, greatest(size(words) - {window - 1}, 1))")
    each = words.filter(F.size("words") > 0).select("item_id", F.explode_outer(F.transform(starts, lambda i: F.slice("words", i, F.lit(window)))).alias("words"))
    return each.select("item_id", F.concat_ws(" ", "words").alias("w"), F.size("words").alias("len")).distinct()


def shingles(words: Column, size: int) -> Column:
    """The hash of the `size` words from each place of an array on where there are so many."""
    here = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, size)]))
    return F.slice(here, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))


def window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """w, len, off (place in the window), width (words), h: the shingles of distinct windows."""
    words = windows.select("w", "len").distinct().withColumn("words", F.split("w", " "))
    parts = [words.filter(F.col("len") >= size).select("w", "len", F.lit(size).alias("width"), F.posexplode_outer(shingles(F.col("words"), size)).alias("off", "h"))]
    for n in range(1, size):
        parts.append(words.filter(F.col("len") == n).select("w", "len", F.lit(n).alias("width"), F.posexplode_outer(shingles(F.col("words"), n)).alias("off", "h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def tokens(docs: DataFrame, widths: list[int], names: list[str]) -> DataFrame:
    """names, n_words, h1, h2, ...: hashes of the shingles of each width from each place on, of rows with a column text."""
    words = docs.select(*names, words_of(F.col("text")).alias("words"))
    return words.select(*names, F.size("words").alias("n_words"), *[shingles(F.col("words"), n).alias(f"h{n}") for n in widths])


def find_windows(table: DataFrame, windows: DataFrame, size: int, widths: list[int]) -> DataFrame:
    """k1, k2, start, len, w of each place where a window occurs, once for identical texts. table: tokens() of the texts."""
    # Each distinct window's shingles, and what to look for.
    terms = cut_small(window_shingles(windows, size), "shingles")
    vocabulary = terms.select("width", "h").distinct()
    places = None
    for n in widths:
        own = table.select("k1", "k2", "n_words", F.posexplode_outer(f"h{n}").alias("i", "h")).join(vocabulary.filter(F.col("width") == n).select("h"), "h").select("k1", "k2", "n_words", "i", F.lit(n).alias("width"), "h")
        places = own if places is None else places.union(own)
    # Copies of a text have one key, and count each for rarity.
    places = cut(places.groupBy("k1", "k2", "n_words", "i", "width", "h").agg(F.count("*").alias("n")), "places")
    counts = places.groupBy("width", "h").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct("n", "h", "off", "width")).alias("r")
    rare = cut_small(terms.join(counts, ["width", "h"]).groupBy("w", "len").agg(rarest, F.count("*").alias("found")).filter(F.col("found") == F.greatest(F.col("len") - (size - 1), F.lit(1))).select("w", "len", "r.h", "r.off", "r.width"), "rarest")
    start = F.col("i") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    candidates = cut_small(places.join(rare, ["width", "h"]).filter(fits).select("k1", "k2", start.alias("start"), "len", "w"), "candidates")
    # Verified: all shingles of the window are where they have to be.
    each = candidates.join(terms.select("w", "off", "width", "h"), "w").select("k1", "k2", "start", "len", "w", (F.col("start") + F.col("off")).alias("i"), "width", "h")
    hits = each.join(places.select("k1", "k2", "i", "width", "h"), ["k1", "k2", "i", "width", "h"]).groupBy("k1", "k2", "start", "len", "w").agg(F.count("*").alias("n"))
    return cut_small(hits.filter(F.col("n") == F.greatest(F.col("len") - (size - 1), F.lit(1))).drop("n"), "hits")


def prepared(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame, list[int], int]:
    """(docs in a session of its own, windows of the items, widths of their shingles, words of a shingle)."""
    docs = bounded(docs)
    windows = cut_small(item_windows(items, item_id, item_text, window), "item-windows")
    size = min(SHINGLE, window)
    short = windows.filter(F.col("len") < size).select("len").distinct().collect()  # at most two numbers
    return docs, windows, [size, *sorted(r.len for r in short)], size


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (sorted ids of the items that occur), contaminated."""
    docs, windows, widths, size = prepared(docs, items, text, item_id, item_text, window)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *text_key(F.col(f"`{text}`")), F.col(f"`{text}`").alias("text"))
    table = cut(tokens(rows, widths, ["doc_id", "k1", "k2"]), "tokens")
    hits = find_windows(table, windows, size, widths)
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + len - 1)")))))
    marks = hits.groupBy("k1", "k2").agg(covered.alias("n_hit"))
    ids = hits.select("k1", "k2", "w").distinct().join(windows.select("w", "item_id"), "w").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    marks = cut_small(marks.join(ids, ["k1", "k2"]), "marks")
    return table.join(marks, ["k1", "k2"], "left").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce(F.col("n_hit").cast("long"), F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The documents without any occurrence of a window, all columns as they came."""
    docs, windows, widths, size = prepared(docs, items, text, item_id, item_text, window)
    k1, k2 = text_key(F.col(f"`{text}`"))
    hits = find_windows(tokens(docs.select(k1, k2, F.col(f"`{text}`").alias("text")), widths, ["k1", "k2"]), windows, size, widths)
    bad = cut_small(hits.select("k1", "k2").distinct(), "contaminated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1, k2)
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("row.*")
