"""Teletext packets to pages: address and header, transmissions, votes over copies, versions, text, subtitles and quality.

packets: recording, seq, packet (42 bytes). Order is (recording, seq). A magazine of a recording is one ordered stream, so
recordings x 8 is how far pagination spreads; all later steps are keyed by page, row and column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import codes
from concord.functions import columns as K
from concord.operators import votes
from concord.plans.work import arrow_udf

WIDTH = 40


def parse(packets: DataFrame, exact: bool = False) -> DataFrame:
    """recording, seq, magazine, row, payload (bytes 3 to 42), and for headers page (0 to 255, null if unreadable), subcode, control (11 bits); packets whose address can't be read are left out. exact: addresses with a wrong bit are not mended."""
    address = K.packet_address(K.byte_at(F.col("packet"), 0), K.byte_at(F.col("packet"), 1), not exact)
    rows = packets.filter(F.length("packet") == 42).withColumn("_a", address).filter("_a IS NOT NULL")
    nibble = lambda k: K.hamming84(K.byte_at(F.col("packet"), k))
    digits = F.transform(F.array(*[nibble(k) for k in range(2, 10)]), lambda x: x.cast("int"))
    rows = rows.select("recording", "seq", "_a.magazine", "_a.row", F.substring("packet", 3, 40).alias("payload"), F.when(F.col("_a.row") == 0, digits).alias("_d"))
    d = [F.get("_d", F.lit(k)) for k in range(8)]
    good = (d[0] >= 0) & (d[1] >= 0)
    sub = d[2] + d[3].bitwiseAND(F.lit(7)) * 16 + d[4] * 256 + d[5].bitwiseAND(F.lit(3)) * 4096
    control = F.shiftright(d[3], 3) + F.shiftright(d[5], 2) * 2 + d[6] * 8 + d[7] * 128
    readable = good & F.forall(F.slice("_d", 3, 4), lambda x: x >= 0)
    return rows.select("recording", "seq", "magazine", "row", "payload", F.when(good, d[1] * 16 + d[0]).alias("page"), F.when(readable, sub).alias("subcode"), F.when(readable & (d[6] >= 0) & (d[7] >= 0), control).alias("control"))


def paginate(parsed: DataFrame, keys: Sequence[str] = ("recording", "magazine")) -> DataFrame:
    """Rows 0 to 24 with tx (the number of the transmission), page and subcode of the header that opened it.

    A header closes the page before it in its magazine. Page 255 only fills time. A transmission needs a header that can be read
    and one more row; of a row that is there twice, the last stays.
    """
    w = W.partitionBy(*keys).orderBy("seq")
    head = F.col("row") == 0
    opened = parsed.filter("row <= 24").withColumn("tx", F.sum(F.when(head, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    key = [*keys, "tx"]
    heads = F.max(F.when(head, F.struct("page", "subcode", "control"))).over(W.partitionBy(*key))
    every = F.count("*").over(W.partitionBy(*key))
    last = F.max("seq").over(W.partitionBy(*key, "row"))
    held = opened.withColumn("_h", heads).withColumn("_n", every).withColumn("_last", last)
    return held.filter("_h.page IS NOT NULL AND _h.page <> 255 AND _n > 1 AND seq = _last").select(*keys, "tx", "seq", "row", "payload", F.col("_h.page").alias("page"), F.col("_h.subcode").alias("subcode"), F.col("_h.control").alias("control"))


def cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row, column, byte (seven bits; null where the parity is wrong), copies: headers from column 8 on, where their text begins. Equal payloads of a row are one, with the number of copies."""
    once = rows.groupBy(*keys, "row", "payload").agg(F.count("*").alias("copies"))
    each = once.select(*keys, "row", "copies", F.posexplode(K.byte_list(F.col("payload"))).alias("column", "_b"))
    return each.filter("row > 0 OR column >= 8").select(*keys, "row", "column", F.when(K.odd_parity(F.col("_b")), F.col("_b").bitwiseAND(F.lit(0x7F))).alias("byte"), "copies")


def vote_pages(rows: DataFrame, keys: Sequence[str] = ("magazine", "page", "subcode")) -> DataFrame:
    """keys, row, text, least: column by column the commonest byte of all copies with right parity (ties to the smallest), a space where none has; least is the fewest copies behind a column."""
    by = cells(rows, keys).filter("byte IS NOT NULL").groupBy(*keys, "row", "column", "byte").agg(F.sum("copies").alias("n"))
    won = by.groupBy(*keys, "row", "column").agg(F.max(F.struct("n", (-F.col("byte")).alias("b"))).alias("_m"))
    filled = F.map_from_entries(F.collect_list(F.struct("column", (-F.col("_m.b")).alias("b"))))
    by = won.groupBy(*keys, "row").agg(filled.alias("_m"), F.min("_m.n").alias("least"))
    char = lambda i: F.chr(F.greatest(F.coalesce(F.element_at("_m", i), F.lit(32)), F.lit(32)))
    start = F.when(F.col("row") == 0, 8).otherwise(0)
    return by.select(*keys, "row", F.array_join(F.transform(F.sequence(start, F.lit(WIDTH - 1)), char), "").alias("text"), "least")


def quorum_pages(rows: DataFrame, least: int = 3, keys: Sequence[str] = ("magazine", "page")) -> DataFrame:
    """The rows of the subcodes that came in at least `least` transmissions, or of a page's commonest one."""
    counts = rows.filter("row = 0").groupBy(*keys, "subcode").agg(F.count("*").alias("copies"))
    kept = votes.quorum(counts.filter("subcode IS NOT NULL"), keys, "subcode", "copies", least)
    return rows.join(kept, [*keys, "subcode"])


def page_text(voted: DataFrame, keys: Sequence[str] = ("magazine", "page", "subcode")) -> DataFrame:
    """keys, text: the rows of a page in order, a line each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: F.rtrim(x["text"]))
    return voted.filter("row > 0").groupBy(*keys).agg(F.array_join(lines, "\n").alias("text"))


def versions(rows: DataFrame, keys: Sequence[str] = ("magazine", "page", "subcode")) -> DataFrame:
    """keys, version (from 1, by first transmission), copies, first, last: transmissions with the same content, told apart by a hash of all their rows."""
    seen = rows.filter("row > 0").groupBy("recording", *keys, "tx").agg(F.min("seq").alias("at"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.hex("payload").alias("p")))), lambda x: F.concat_ws(":", x["row"].cast("string"), x["p"])), ","), 256).alias("_c"))
    same = seen.groupBy(*keys, "_c").agg(F.count("*").alias("copies"), F.min("at").alias("first"), F.max("at").alias("last"))
    return same.withColumn("version", F.row_number().over(W.partitionBy(*keys).orderBy("first", "_c"))).drop("_c")


def quality(parsed: DataFrame, per: int = 1000) -> DataFrame:
    """recording, stretch (of `per` packets), packets, wrong: the bytes of wrong parity in rows 1 to 24 of each thousand bytes."""
    bad = F.aggregate(K.byte_list(F.col("payload")), F.lit(0), lambda s, x: s + F.when(K.odd_parity(x), 0).otherwise(1))
    text = parsed.filter("row BETWEEN 1 AND 24")
    return text.groupBy("recording", F.floor(F.col("seq") / per).alias("stretch")).agg(F.count("*").alias("packets"), F.round(F.sum(bad) * 1000 / (F.count("*") * WIDTH), 3).alias("wrong"))


def subtitles(rows: DataFrame, seconds: Column, cap: int = 7) -> DataFrame:
    """recording, magazine, page, start, end, text of each transmission of boxed pages (control bit for subtitles); an end is the next start or `cap` seconds on."""
    boxed = rows.filter(F.col("control").isNotNull() & (F.shiftright("control", 2).bitwiseAND(F.lit(1)) == 1))
    keys = ["recording", "magazine", "page", "tx"]
    voted = vote_pages(boxed, [*keys, "subcode"])
    text = page_text(voted, [*keys, "subcode"]).withColumn("text", F.trim(F.regexp_replace("text", r"\s*\n\s*", "\n")))
    at = boxed.groupBy(*keys).agg(F.min("seq").alias("seq"))
    cue = at.join(text, keys).withColumn("start", seconds)
    w = W.partitionBy("recording", "magazine", "page").orderBy("seq")
    return cue.withColumn("end", F.least(F.lead("start").over(w), F.col("start") + cap)).filter("text <> ''").select("recording", "magazine", "page", "start", "end", "text")


def subrip(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, srt: cues (start, end in seconds, text) as a SubRip file."""
    stamp = lambda c: F.concat(F.date_format(F.timestamp_seconds(F.floor(c)), "HH:mm:ss"), F.lit(","), F.lpad(F.floor((c - F.floor(c)) * 1000).cast("string"), 3, "0"))
    n = F.row_number().over(W.partitionBy(*keys).orderBy("start", "text"))
    line = F.concat_ws("\n", n.cast("string"), F.concat(stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end"))), F.col("text"), F.lit(""))
    each = cues.select(*keys, "start", n.alias("_n"), line.alias("_l"))
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"]), "\n").alias("srt"))


# --- the other way: packets from pages, for clean copies and for tests


def header(magazine: Column, page: Column, subcode: Column, text: Column, control: Column | None = None) -> Column:
    """A header packet: address, page, subcode and control in Hamming bytes, 32 characters of odd parity."""
    return _packet(F.struct(magazine.alias("m"), F.lit(0).alias("r"), page.alias("p"), subcode.alias("s"), (control if control is not None else F.lit(0)).alias("c"), text.alias("t")))


def text_row(magazine: Column, row: Column, text: Column) -> Column:
    """A packet of 40 characters."""
    return _packet(F.struct(magazine.alias("m"), row.alias("r"), F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(0).alias("c"), text.alias("t")))


def _packet(parts: Column) -> Column:
    @arrow_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        m, r, p, s, c = (rows[x].to_numpy(np.int64) for x in "mrpsc")
        out = np.zeros((len(rows), 42), np.uint8)
        out[:, :2] = codes.encode_hamming84(np.stack([(m & 7) | (r & 1) << 3, r >> 1], axis=1).ravel()).reshape(-1, 2)
        for width, own in ((32, np.flatnonzero(r == 0)), (40, np.flatnonzero(r != 0))):
            texts = b"".join((t or "").encode("ascii", "replace")[:width].ljust(width) for t in rows["t"].to_numpy()[own])
            out[own, 42 - width :] = codes.with_odd_parity(np.frombuffer(texts, np.uint8)).reshape(-1, width)
            if width == 32 and len(own):
                p, s, c = p[own], s[own], c[own]
                digits = [p & 15, p >> 4, s & 15, (s >> 4 & 7) | (c & 1) << 3, s >> 8 & 15, (s >> 12 & 3) | (c >> 1 & 3) << 2, c >> 3 & 15, c >> 7 & 15]
                out[own, 2:10] = codes.encode_hamming84(np.stack(digits, axis=1).ravel()).reshape(-1, 8)
        return pd.Series([x.tobytes() for x in out])

    return run(parts)


def to_packets(pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, seq, packet: a clean stream for each of keys, each page's header and rows (magazine, page, subcode, row, text; row 0 is the header) one after the other."""
    page, line = [*keys, "magazine", "page", "subcode"], [*keys, "magazine", "page", "subcode", "row", "text"]
    heads = pages.select(*page).distinct().select("*", F.lit(0).alias("row"), F.lit("").alias("text"))
    given = pages.filter("row = 0").select(*line)
    heads = heads.join(given.select(*page), page, "left_anti").unionByName(given)
    every = heads.unionByName(pages.filter("row > 0").select(*line))
    code = _packet(F.struct(F.col("magazine").alias("m"), F.col("row").alias("r"), F.col("page").alias("p"), F.col("subcode").alias("s"), F.lit(0).alias("c"), F.col("text").alias("t")))
    # The order of pages is that of their numbers; a page number, subcode and row fit one long.
    seq = ((F.col("magazine").cast("long") * 256 + F.col("page")) * 16384 + F.col("subcode")) * 32 + F.col("row")
    return every.select(*keys, seq.alias("seq"), code.alias("packet"))


def packet_times(rows: DataFrame, keys: Sequence[str], order: str, known: str | None = None, rate: float = 650.0) -> DataFrame:
    """rows with second: the time of the frame that a line map gives (`known`, seconds, null where it has none), carried on from the last one that has it; without any before, the packet's number over `rate`."""
    w = W.partitionBy(*keys).orderBy(order)
    number = F.row_number().over(w) - 1
    if known is None:
        return rows.withColumn("second", number / rate)
    return rows.withColumn("second", F.coalesce(F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), number / rate))


def subcode_groups(rows: DataFrame, keys: Sequence[str], subcode: str = "subcode") -> DataFrame:
    """rows with group: copies of a page with the same lower two digits of the subcode, seven bits, are one; a copy without a subcode has none."""
    return rows.withColumn("group", F.col(subcode).bitwiseAND(F.lit(0x7F)))
