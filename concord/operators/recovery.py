"""Recovering what damage took from a page stream: headers, subcodes, links, full pages from partial copies, charsets, titles.

Works on what pages.parse() and pages.paginate() give. Everything is joins and aggregations keyed by page, row or text; only the
succession of headers needs the order of a magazine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import columns as K
from concord.operators import votes


def recover_headers(parsed: DataFrame, keys: Sequence[str] = ("recording", "magazine"), least: int = 2, percent: int = 60) -> DataFrame:
    """parsed with the page of unreadable headers filled in: the page that usually follows the one before it.

    The usual successor needs `least` sightings and `percent` of all; a header whose own predecessor can't be read stays unknown.
    """
    heads = parsed.filter("row = 0")
    w = W.partitionBy(*keys).orderBy("seq")
    chained = heads.select(*keys, "seq", "page", F.lag("page").over(w).alias("_before"))
    usual = votes.pick(chained.filter("page IS NOT NULL AND _before IS NOT NULL"), [*keys, "_before"], "page", least=least, percent=percent).select(*keys, "_before", F.col("page").alias("_page"))
    guess = chained.filter("page IS NULL AND _before IS NOT NULL").join(usual, [*keys, "_before"]).select(*keys, "seq", "_page")
    return parsed.join(guess, [*keys, "seq"], "left").withColumn("guessed", F.col("_page").isNotNull()).withColumn("page", F.coalesce("page", "_page")).drop("_page")


def own_orphans(rows: DataFrame, orphans: DataFrame, page: Sequence[str], row: str, text: str, *, least: int = 3, lead: int = 3) -> DataFrame:
    """orphan, page: loose rows (orphan, row, text) whose texts point to one page: the page that has most of them, with `least` rows and `lead` times the second's."""
    owners = rows.select(*page, row, text).distinct()
    met = orphans.join(owners, [row, text]).groupBy("orphan", *page).agg(F.countDistinct(row).alias("n"))
    best = met.groupBy("orphan").agg(F.max(F.struct("n", *page)).alias("_m"), F.sort_array(F.collect_list("n"), False).alias("_n"))
    return best.filter((F.col("_n")[0] >= least) & (F.col("_n")[0] >= lead * F.coalesce(F.get("_n", F.lit(1)), F.lit(0)))).select("orphan", *[F.col(f"_m.{c}").alias(c) for c in page], F.col("_m.n").alias("n"))


def known_subcodes(rows: DataFrame, keys: Sequence[str] = ("magazine", "page"), least: int = 3, ratio: int = 10) -> DataFrame:
    """keys, subcode, n: the subcodes of a page that came in `least` transmissions and a `ratio`-th as often as its commonest."""
    return votes.rare_filter(rows.filter("row = 0 AND subcode IS NOT NULL"), list(keys), "subcode", least=least, ratio=ratio)


def assign_subcodes(rows: DataFrame, keys: Sequence[str] = ("magazine", "page"), least: int = 3) -> DataFrame:
    """rows with the subcode of transmissions that have none: the known one whose voted rows agree with most of theirs (ties to the smallest), or the last one known before."""
    known = known_subcodes(rows, keys, least)
    sure = rows.join(known.select(*keys, "subcode"), [*keys, "subcode"], "left_semi").filter("row > 0")
    model = votes.vote(sure.withColumn("_t", F.hex("payload")), [*keys, "subcode", "row"], "_t").select(*keys, F.col("subcode").alias("_sub"), "row", "_t")
    lost = rows.filter("subcode IS NULL AND row > 0").withColumn("_t", F.hex("payload"))
    tx = ["recording", *keys, "tx"]
    match = lost.join(model, [*keys, "row", "_t"]).groupBy(*tx, "_sub").agg(F.count("*").alias("_n"))
    best = match.groupBy(*tx).agg(F.min_by("_sub", F.struct(-F.col("_n"), "_sub")).alias("_best"))
    w = W.partitionBy("recording", *keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_last", F.last("subcode", ignorenulls=True).over(w)).join(best, tx, "left").withColumn("subcode", F.coalesce("subcode", "_best", "_last")).drop("_best", "_last")


def counters(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """rows with part and parts of a counter such as 03/12 in the text (null where there is none, or it can't be)."""
    part, parts = (F.regexp_extract(text, r"(?<![0-9/])([0-9]{2})/([0-9]{2})(?![0-9/])", k) for k in (1, 2))
    found = rows.withColumn("part", F.when(part != "", part.cast("int"))).withColumn("parts", F.when(parts != "", parts.cast("int")))
    fine = (F.col("part") >= 1) & (F.col("part") <= F.col("parts"))
    return found.withColumn("part", F.when(fine, F.col("part"))).withColumn("parts", F.when(fine, F.col("parts")))


def rotations_by_counter(copies: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """keys, part, copies of pages whose copies have at least two different counters, each kept with `least` copies."""
    by = copies.filter("part IS NOT NULL").groupBy(*keys, "part").agg(F.count("*").alias("copies")).filter(F.col("copies") >= least)
    return by.withColumn("_k", F.count("*").over(W.partitionBy(*keys))).filter("_k >= 2").drop("_k")


def content_groups(rows: DataFrame, keys: Sequence[str], copy: str, row: str, text: str, *, share: float = 0.8, least: int = 2, ratio: int = 10) -> DataFrame:
    """keys, copy, group, weight: copies with equal content are a group; a group that has `share` of its rows in common with a heavier one joins it (the heaviest such); groups lighter than `least`, or than a `ratio`-th of the page's heaviest, are left out."""
    body = rows.groupBy(*keys, copy).agg(F.array_sort(F.collect_set(F.struct(row, text))).alias("_rows"))
    one = body.withColumn("_c", F.xxhash64("_rows"))
    groups = one.groupBy(*keys, "_c").agg(F.count("*").alias("_n"), F.any_value("_rows").alias("_rows"))
    lines = groups.select(*keys, "_c", "_n", F.size("_rows").alias("_size"), F.explode("_rows").alias("_r"))
    other = lines.select(*keys, F.col("_c").alias("_d"), F.col("_n").alias("_m"), "_r")
    heavier = (F.col("_m") > F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("_d") < F.col("_c")))
    met = lines.join(other, [*keys, "_r"]).filter(heavier).groupBy(*keys, "_c", "_size", "_d", "_m").agg(F.count("*").alias("_same"))
    to = met.filter(F.col("_same") >= share * F.col("_size")).groupBy(*keys, "_c").agg(F.min_by("_d", F.struct(-F.col("_m"), "_d")).alias("_to"))
    # One step: a group that joins another takes that one's own place, not where it goes in turn.
    placed = groups.join(to, [*keys, "_c"], "left").withColumn("group", F.coalesce("_to", "_c"))
    weight = placed.groupBy(*keys, "group").agg(F.sum("_n").alias("weight"))
    top = F.max("weight").over(W.partitionBy(*keys))
    kept = weight.withColumn("_top", top).filter((F.col("weight") >= least) & (F.col("weight") * ratio >= F.col("_top"))).drop("_top")
    return one.join(placed.select(*keys, "_c", "group"), [*keys, "_c"]).join(kept, [*keys, "group"]).select(*keys, copy, "group", "weight")


def full_rows(rows: DataFrame, keys: Sequence[str], row: str, text: str, at: str, *, most: int = 6, width: int = 40) -> DataFrame:
    """keys, row, text, weight: of a row's variants the one with most copies within `most` places of it, ties to the newest."""
    variants = rows.filter(F.col(text).isNotNull()).groupBy(*keys, row, text).agg(F.count("*").alias("_n"), F.max(at).alias("_at"))
    other = variants.select(*keys, row, F.col(text).alias("_o"), F.col("_n").alias("_m"))
    chars = lambda c: F.split(F.rpad(F.col(c), width, " "), "")
    off = F.aggregate(F.zip_with(chars(text), chars("_o"), lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    scored = variants.join(other, [*keys, row]).filter(off <= most).groupBy(*keys, row, text, "_at").agg(F.sum("_m").alias("weight"))
    best = F.max(F.struct("weight", "_at", F.col(text).alias("_t")))
    return scored.groupBy(*keys, row).agg(best.alias("_b")).select(*keys, row, F.col("_b._t").alias(text), F.col("_b.weight").alias("weight"))


def links(parsed: DataFrame) -> DataFrame:
    """recording, seq, magazine, place (0 to 5), page, subcode of the editorial links of a page (row 27, first designation); a page of 255 is no link, and the magazine is the sender's with the bits that the link flips."""
    nib = lambda k: K.hamming84(K.byte_at(F.col("payload"), k)).cast("int")
    rows = parsed.filter("row = 27").withColumn("_d", nib(0)).filter("_d = 0")
    every = F.array(*[F.struct(F.lit(k).alias("place"), F.array(*[nib(1 + 6 * k + j) for j in range(6)]).alias("n")) for k in range(6)])
    each = rows.select("recording", "seq", "magazine", F.explode(every).alias("_l")).filter(F.forall("_l.n", lambda x: x >= 0))
    n = [F.col("_l.n")[j] for j in range(6)]
    flips = F.shiftright(n[3], 3) + F.shiftright(n[5], 2) * 2
    to = (F.col("magazine") % 8).bitwiseXOR(flips)
    sub = n[2] + n[3].bitwiseAND(F.lit(7)) * 16 + n[4] * 256 + n[5].bitwiseAND(F.lit(3)) * 4096
    found = each.select("recording", "seq", F.when(to == 0, 8).otherwise(to).alias("magazine"), F.col("_l.place").alias("place"), (n[1] * 16 + n[0]).alias("page"), sub.alias("subcode"))
    return found.filter("page <> 255")


def title(heads: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, title: the commonest middle of a page's headers, without numbers, dates and clocks."""
    middle = F.trim(F.regexp_replace(F.regexp_replace(text, r"[0-9]{1,2}[:./][0-9]{2}([:./][0-9]{2,4})?", " "), r"[0-9P]?[0-9]{2,}", " "))
    return votes.vote(heads.withColumn("title", F.regexp_replace(middle, r"\s+", " ")).filter("title <> ''"), keys, "title").select(*keys, "title")


def guess_charset(texts: DataFrame, keys: Sequence[str], data: str, charsets: Mapping[str, Mapping[int, str]], words: Sequence[str]) -> DataFrame:
    """keys, charset: of several readings of the same bytes (national characters by code), the one with most words of a list, ties to the first name. At most one row of counts a key and charset is compared."""
    known = F.array(*[F.lit(w) for w in words])

    def read(table: Mapping[int, str]) -> Column:
        chars = "".join(chr(c) for c in table)
        return F.lower(F.translate(F.decode(F.col(data), "ISO-8859-1"), chars, "".join(table.values())))

    scores = F.explode(F.array(*[F.struct(F.lit(name).alias("charset"), F.size(F.filter(F.split(read(table), r"[^\p{L}]+"), lambda w: F.array_contains(known, w))).alias("n")) for name, table in sorted(charsets.items())]))
    by = texts.select(*keys, scores.alias("s")).groupBy(*keys, "s.charset").agg(F.sum("s.n").alias("n"))
    return by.groupBy(*keys).agg(F.min_by("charset", F.struct(-F.col("n"), "charset")).alias("charset"))
