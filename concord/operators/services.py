"""Services on decoded bytes and words: labels, signalling bits, time codes, network information, data packets, on-air summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import codes
from concord.functions import columns as K
from concord.plans.work import arrow_udf

#: What the first three bits of the signalling say, and types of files by their first bytes (hex).
ASPECTS = ("4:3 full", "14:9 letterbox centre", "14:9 letterbox top", "16:9 letterbox centre", "16:9 letterbox top", "more than 16:9 letterbox centre", "14:9 full", "16:9 full")
MAGIC = {"504B0304": "zip", "52617221": "rar", "60EA": "arj", "1F8B": "gzip", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "25504446": "pdf", "4D5A": "exe", "0A05": "pcx", "49492A00": "tiff", "4D4D002A": "tiff", "424D": "bmp"}


def file_type(data: Column) -> Column:
    """The type of a file by its first bytes; text if they are printable, else null."""
    head = F.hex(F.substring(data, 1, 8))
    found = F.when(head.rlike("^(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])+$"), "text")
    for magic in sorted(MAGIC, key=len):
        found = F.when(head.startswith(magic), MAGIC[magic]).otherwise(found)
    return found


def programme_label(data: Column) -> Column:
    """day, month, hour, minute, cni, pty and sound of a 13-byte programme label (bytes 3 to 15 of the line)."""
    b = lambda k: K.byte_at(data, k)
    pil = b(8).bitwiseAND(F.lit(0x3F)) * 16384 + b(9) * 64 + F.shiftright(b(10), 2)
    cni = b(10).bitwiseAND(F.lit(3)) * 1024 + b(11).bitwiseAND(F.lit(0xC0)) * 4 + b(8).bitwiseAND(F.lit(0xC0)) + b(11).bitwiseAND(F.lit(0x3F))
    return F.struct(F.shiftright(pil, 15).alias("day"), F.shiftright(pil, 11).bitwiseAND(F.lit(15)).alias("month"), F.shiftright(pil, 6).bitwiseAND(F.lit(31)).alias("hour"), pil.bitwiseAND(F.lit(63)).alias("minute"), cni.alias("cni"), b(12).alias("pty"), F.shiftright(b(2), 6).alias("sound"))


def plausible_label(label: Column) -> Column:
    """Whether a label is a date and time there can be."""
    return label["day"].between(1, 31) & label["month"].between(1, 12) & label["hour"].between(0, 23) & label["minute"].between(0, 59)


def make_label(day: Column, month: Column, hour: Column, minute: Column, cni: Column, pty: Column) -> Column:
    """The 13 bytes of a label."""

    @arrow_udf("binary")
    def run(d: pd.Series, m: pd.Series, h: pd.Series, n: pd.Series, c: pd.Series, p: pd.Series) -> pd.Series:
        d, m, h, n, c, p = (x.to_numpy(np.int64) for x in (d, m, h, n, c, p))
        pil = d << 15 | m << 11 | h << 6 | n
        out = np.zeros((len(d), 13), np.uint8)
        out[:, 8], out[:, 9], out[:, 10] = (c & 0xC0) | pil >> 14, pil >> 6 & 255, (pil & 63) << 2 | c >> 10 & 3
        out[:, 11], out[:, 12] = (c & 0x3F) | (c >> 2 & 0xC0), p & 255
        return pd.Series([bytes(r) for r in out])

    return run(day, month, hour, minute, cni, pty)


def signalling(word: Column) -> Column:
    """aspect, film, colour_plus, helper, subtitles_in_teletext, open_subtitles, surround, copyright, copy_restricted of 14 signalling bits; null where the first four have even parity."""
    flag = lambda k: K.bits(word, k, 1) == 1
    aspect = F.element_at(F.lit([*ASPECTS]), K.bits(word, 0, 3).cast("int") + 1)
    held = F.struct(aspect.alias("aspect"), flag(4).alias("film"), flag(5).alias("colour_plus"), flag(6).alias("helper"), flag(8).alias("subtitles_in_teletext"), K.bits(word, 9, 2).alias("open_subtitles"), flag(11).alias("surround"), flag(12).alias("copyright"), flag(13).alias("copy_restricted"))
    return F.when(F.bit_count(K.bits(word, 0, 4)) % 2 == 1, held)


def word_fields(word: Column, fields: Sequence[tuple[str, int]], width: int) -> Column:
    """Named fields of a word, the highest bits first."""
    at, out = width, []
    for name, size in fields:
        at -= size
        out.append(K.bits(word, at, size).alias(name))
    return F.struct(*out)


#: A monitoring word of 48 bits, the highest first.
MONITOR = (("sync", 3), ("start", 4), ("address", 5), ("payload", 35), ("parity", 1))


def monitor_word(word: Column) -> Column:
    """address, payload and whether the parity over address, payload and parity bit is odd; null without the sync 101 0110."""
    f = word_fields(word, MONITOR, 48)
    return F.when((f["sync"] == 0b101) & (f["start"] == 0b0110), F.struct(f["address"].alias("address"), f["payload"].alias("payload"), (F.bit_count(word.bitwiseAND(F.lit((1 << 41) - 1))) % 2 == 1).alias("parity_ok")))


def time_code_line(bits: Column) -> Column:
    """h, m, s, f, drop, user (long) of a time code line given as a string of 90 zeros and ones; null where a sync pair or the check is wrong."""

    @arrow_udf("h int, m int, s int, f int, drop boolean, user long")
    def run(lines: pd.Series) -> pd.DataFrame:
        out = []
        for line in lines:
            b = np.array([c == "1" for c in line or ""], np.uint8)
            if len(b) != 90 or not all(b[10 * k] == 1 and b[10 * k + 1] == 0 for k in range(9)) or not np.array_equal(codes.vitc_crc(b[None, :82])[0], b[82:]):
                out.append((None,) * 6)
                continue
            nibble = lambda k, n=4, b=b: int((b[k : k + n] << np.arange(n)).sum())
            f, s, m, h = (nibble(k) + 10 * nibble(k + 10, n) for k, n in ((2, 2), (22, 3), (42, 3), (62, 2)))
            user = sum(nibble(6 + 10 * k) << 4 * k for k in range(8))
            out.append((h, m, s, f, bool(b[14]), user))
        return pd.DataFrame(out, columns=["h", "m", "s", "f", "drop", "user"]).astype({"h": "Int32", "m": "Int32", "s": "Int32", "f": "Int32", "user": "Int64"})

    return run(bits)


def make_time_code_line(h: int, m: int, s: int, f: int, drop: bool = False, user: int = 0) -> str:
    """The 90 bits of a time code line."""
    b = np.zeros(82, np.uint8)
    b[0:82:10] = 1
    for k, (v, n) in enumerate([(f % 10, 4), (f // 10, 2), (s % 10, 4), (s // 10, 3), (m % 10, 4), (m // 10, 3), (h % 10, 4), (h // 10, 2)]):
        b[2 + 10 * k : 2 + 10 * k + n] = v >> np.arange(n) & 1
        b[6 + 10 * k : 10 + 10 * k] = user >> (4 * k + np.arange(4)) & 1
    b[14] = drop
    return "".join(map(str, [*b, *codes.vitc_crc(b[None])[0]]))


def service_information(payload: Column, six_digits: bool = False) -> Column:
    """network, offset_minutes, date, time (seconds of the day) and status of a format 1 service packet, from its 40 bytes after the address.

    Five digits of a date end in 2132. six_digits: the bits beside the first digit, which the format leaves free, hold one more before it.
    The payload is read at many places, so it should be a plain column.
    """
    b = lambda k: K.byte_at(payload, k)
    digit = lambda v: F.pmod(v - 1, F.lit(16))
    two = lambda k: digit(F.shiftright(b(k), 4)) * 10 + digit(b(k).bitwiseAND(F.lit(15)))
    mjd = (two(10) if six_digits else digit(b(10).bitwiseAND(F.lit(15)))) * 10000 + two(11) * 100 + two(12)
    half = K.bits(b(9), 1, 5) * 30 * F.when(K.bits(b(9), 6, 1) == 1, -1).otherwise(1)
    status = F.transform(F.sequence(F.lit(20), F.lit(39)), lambda i: F.chr(F.greatest(K.strip_parity(K.byte_at(payload, i)), F.lit(32))))
    network = K.reverse_bits(b(7)) * 256 + K.reverse_bits(b(8))
    return F.struct(network.alias("network"), half.alias("offset_minutes"), K.mjd_date(mjd).alias("date"), (two(13) * 3600 + two(14) * 60 + two(15)).alias("time"), F.rtrim(F.array_join(status, "")).alias("status"))


def extended_data(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, class, type, data, at: extended data packets from byte pairs (seq, a, b without parity) of a field.

    01-0E opens a packet of a class or goes on with it after another has cut in; 0F and a checksum close it; the sum of all bytes
    is 0 modulo 128 in a packet that is whole. A class is one thread, so packets are found by running sums over its own pairs.
    """
    start = (F.col("a") >= 1) & (F.col("a") <= 0x0E)
    w = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    kind = F.last(F.when(start, F.floor((F.col("a") + 1) / 2)).when(F.col("a") >= 0x10, F.when(F.col("a") < 0x20, F.lit(0))), True).over(w)
    threads = pairs.withColumn("class", kind).filter("class > 0 AND (a <> 0 OR b <> 0)")
    t = W.partitionBy(*keys, "class").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    numbered = threads.withColumn("_open", F.sum(F.when(start & (F.col("a") % 2 == 1), 1).otherwise(0)).over(t)).filter("_open > 0").filter(~(start & (F.col("a") % 2 == 0)))
    rows = F.array_sort(F.collect_list(F.struct("seq", "a", "b")))
    held = numbered.groupBy(*keys, "class", "_open").agg(rows.alias("_r"))
    ended = F.element_at("_r", -1)["a"] == 0x0F
    total = F.aggregate("_r", F.lit(0), lambda s, x: (s + x["a"].cast("int") + x["b"].cast("int")) % 128)
    text = F.aggregate(F.slice("_r", 2, F.greatest(F.size("_r") - 2, F.lit(0))), F.lit(""), lambda s, x: F.concat(s, F.when(x["a"] > 0, F.chr(x["a"])).otherwise(""), F.when(x["b"] > 0, F.chr(x["b"])).otherwise("")))
    whole = held.filter(ended & (total == 0))
    return whole.select(*keys, "class", F.element_at("_r", 1)["b"].cast("int").alias("type"), text.alias("data"), F.element_at("_r", 1)["seq"].alias("at"))


def good_stretches(pairs: DataFrame, keys: Sequence[str], stretch: int = 240, least: float = 0.9) -> DataFrame:
    """The byte pairs (seq, a, b with parity) of stretches whose share of bytes with right parity is at least `least`."""
    part = F.floor(F.col("seq") / (stretch // 2))
    ok = K.odd_parity(F.col("a")).cast("int") + K.odd_parity(F.col("b")).cast("int")
    marked = pairs.withColumn("_part", part)
    good = marked.groupBy(*keys, "_part").agg((F.sum(ok) / (2 * F.count("*"))).alias("_share")).filter(F.col("_share") >= least)
    return marked.join(good.drop("_share"), [*keys, "_part"]).drop("_part")


def on_air(clock: DataFrame, slots: DataFrame, keys: Sequence[str], at: str, start: str, minutes: str) -> DataFrame:
    """clock with the slot that is on the air, and the one after it in its channel."""
    from concord.operators.timeline import in_interval

    w = W.partitionBy(*keys).orderBy(start)
    ahead = slots.withColumn("_end", F.col(start) + F.col(minutes)).withColumn("following", F.lead(start).over(w))
    return in_interval(clock, ahead, keys, at, start, "_end", 60).drop("_end")


def assemble(blocks: DataFrame, name: str, number: str, data: str, expected: str) -> DataFrame:
    """name, data (in order), blocks, expected, whole: files from numbered blocks, each block by vote over its copies."""
    from concord.operators.votes import vote

    total = vote(blocks, [name], expected).select(name, F.col(expected).alias("expected"))
    one = vote(blocks.withColumn("_d", F.base64(data)), [name, number], "_d").select(name, number, F.unbase64("_d").alias("_d"))
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(number, "_d"))), lambda x: x["_d"]), F.lit(b""), lambda s, x: F.concat(s, x))
    return one.groupBy(name).agg(joined.alias("data"), F.count("*").alias("blocks")).join(total, name).withColumn("whole", F.col("blocks") == F.col("expected"))
