"""Data services: packets with continuity, learnt checks, records cut at line ends, re-sent items, captions."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import codes
from concord.functions import columns as K
from concord.operators import similarity, votes
from concord.plans.work import arrow_udf, shipped


def learnt_check(df: DataFrame, keys: Sequence[str], payload: str, sent: str, *, width: int = 32, poly: int = 0x04C11DB7) -> DataFrame:
    """df with good: what is left of the sent check after the payload's own is the header's part, which isn't known; it is learnt as the remainder that one key's packets agree on (three copies of different payloads, twice the second), and a packet is good if it has it."""
    left = K.crc_column(F.col(payload), width, poly).bitwiseXOR(F.col(sent))
    marked = df.withColumn("_left", left)
    agreed = votes.consensus(marked, keys, "_left", payload).select(*keys, F.col("_left").alias("_right"))
    return marked.join(agreed, list(keys), "left").withColumn("good", F.coalesce(F.col("_left") == F.col("_right"), F.lit(False))).drop("_left", "_right")


def with_continuity(df: DataFrame, keys: Sequence[str], order: str, index: str, modulo: int = 16) -> DataFrame:
    """df with lost (packets missing before it) and repeated (the index of the one before it)."""
    w = W.partitionBy(*keys).orderBy(order)
    step = F.pmod(F.col(index) - F.lag(index).over(w), F.lit(modulo))
    return df.withColumn("repeated", F.coalesce(step == 0, F.lit(False))).withColumn("lost", F.coalesce(F.when(step > 0, step - 1), F.lit(0)))


def implied_index(rows: DataFrame, keys: Sequence[str], order: str, data: str, sent: str) -> DataFrame:
    """rows with index and good: the check covers a continuity index that isn't sent. A remainder whose bytes agree gives the index; a packet whose remainder is one bit from the index expected next is mended, others are not good."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own, index, good, expected = own.sort_values(order, kind="stable"), [], [], None
        for d, s in zip(own[data], own[sent], strict=True):
            left = int(codes.crc(np.frombuffer(bytes(d), np.uint8)[None], 16, 0x1021)[0]) ^ int(s)
            value, ok = left & 255, left >> 8 == left & 255
            if not ok and expected is not None and bin(left ^ (expected << 8 | expected)).count("1") == 1:
                value, ok = expected, True
            index.append(value if ok else None)
            good.append(ok)
            expected = (value + 1) & 255 if ok else None if expected is None else (expected + 1) & 255
        own["index"], own["good"] = pd.array(index, "Int32"), good
        return own[[*names, "index", "good"]]

    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return shipped(rows).groupBy(*keys).applyInPandas(run, f"{kinds}, index int, good boolean")


def continuations(lines: DataFrame, keys: Sequence[str], order: str, tail: str, head: str, check: str, reach: int = 4, hits: int = 2, lead: int = 3) -> DataFrame:
    """keys, distance: how many lines on a record that a line end cuts goes on. For every distance, the records (tail here, head there) whose CRC-32 comes out right are counted; the best distance needs `hits` and `lead` times the second's."""

    @arrow_udf("boolean")
    def right(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and zlib.crc32(bytes(x) + bytes(y)) == z for x, y, z in zip(a, b, c, strict=True)])

    ahead = lines.select(*keys, F.col(order).alias("_o"), F.col(head).alias("_h")).withColumn("distance", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    ahead = ahead.select(*keys, (F.col("_o") - F.col("distance")).alias(order), "distance", "_h")
    met = lines.filter(F.col(tail).isNotNull()).select(*keys, order, tail, check).join(ahead, [*keys, order]).filter(right(F.col(tail), F.col("_h"), F.col(check)))
    by = met.groupBy(*keys, "distance").agg(F.count("*").alias("n"))
    best = by.groupBy(*keys).agg(F.max_by("distance", F.struct("n", -F.col("distance"))).alias("distance"), F.sort_array(F.collect_list("n"), False).alias("_n"))
    return best.filter((F.col("_n")[0] >= hits) & (F.col("_n")[0] >= lead * F.coalesce(F.get("_n", F.lit(1)), F.lit(0)))).select(*keys, "distance")


def resent(items: DataFrame, key: str, data: str, head: int = 400, share: int = 10) -> DataFrame:
    """a, b: items of one length whose first `head` bytes differ in at most one of `share`."""
    text = F.concat(F.lpad(F.length(data).cast("string"), 12, "0"), F.rpad(F.decode(F.substring(data, 1, head), "ISO-8859-1"), head, "\0"))
    shaped = items.filter(F.col(data).isNotNull()).select(key, text.alias("_t"))
    pairs = similarity.block_pairs(shaped, key, "_t", width=head + 12, most=head // share)
    sizes = items.select(key, F.length(data).alias("_n"))
    same = pairs.join(sizes.select(F.col(key).alias("a"), F.col("_n").alias("_na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("_n").alias("_nb")), "b")
    return same.filter(F.col("distance") * share <= F.least(F.col("_na"), F.lit(head))).filter("_na = _nb").select("a", "b")


#: Characters of captions that aren't ASCII, rows of preamble codes by their first byte and bit 5 of the second.
CAPTION_CHARS = {0x2A: "á", 0x5C: "é", 0x5E: "í", 0x5F: "ó", 0x60: "ú", 0x7B: "ç", 0x7C: "÷", 0x7D: "Ñ", 0x7E: "ñ", 0x7F: "█"}
CAPTION_ROWS = {0x11: (1, 2), 0x12: (3, 4), 0x15: (5, 6), 0x16: (7, 8), 0x17: (9, 10), 0x10: (11, 11), 0x13: (12, 13), 0x14: (14, 15)}


def captions(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end, text: cues of the first channel from byte pairs (seq, a, b without parity): pop-on, roll-up and paint-on, control codes sent twice counted once. end is null where the text stays to the last pair."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seq", kind="stable")
        shown: dict[int, str] = {}
        hidden: dict[int, str] = {}
        mode, row, rows, last, cues, begun = "pop", 15, 2, None, [], None

        def change(at: int, new: dict[int, str]) -> None:
            nonlocal shown, begun
            old, text = "\n".join(shown[r].strip() for r in sorted(shown) if shown[r].strip()), "\n".join(new[r].strip() for r in sorted(new) if new[r].strip())
            if old != text:
                if old and begun is not None:
                    cues.append((begun, at, old))
                begun = at if text else None
            shown = new

        for at, a, b in zip(own["seq"].tolist(), own["a"].tolist(), own["b"].tolist(), strict=True):
            if 0x10 <= a < 0x20:
                if (a, b) == last:
                    last = None
                    continue
                last = (a, b)
                if a == 0x14 and 0x20 <= b < 0x30:
                    if b == 0x20:
                        mode = "pop"
                    elif b in (0x25, 0x26, 0x27):
                        mode, rows, row = "roll", b - 0x23, 15
                    elif b == 0x29:
                        mode = "paint"
                    elif b == 0x2C:
                        change(at, {})
                    elif b == 0x2E:
                        hidden = {}
                    elif b == 0x2F:
                        new, hidden = hidden, dict(shown)
                        change(at, new)
                        mode = "pop"
                    elif b == 0x2D and mode == "roll":
                        change(at, {r - 1: t for r, t in shown.items() if r - 1 > row - rows})
                    elif b == 0x21:
                        held = hidden if mode == "pop" else dict(shown)
                        held[row] = held.get(row, "")[:-1]
                        if mode != "pop":
                            change(at, held)
                elif b >= 0x40 and a in CAPTION_ROWS and mode != "roll":
                    row = CAPTION_ROWS[a][b >> 5 & 1]
                continue
            last = None
            text = "".join(CAPTION_CHARS.get(c, chr(c)) for c in (a, b) if c >= 0x20)
            if text:
                if mode == "pop":
                    hidden[row] = hidden.get(row, "") + text
                else:
                    change(at, {**shown, row: shown.get(row, "") + text}) if mode == "paint" or not shown.get(row) else shown.__setitem__(row, shown[row] + text)
        old = "\n".join(shown[r].strip() for r in sorted(shown) if shown[r].strip())
        if old and begun is not None:
            cues.append((begun, None, old))
        first = [own[k].iloc[0] for k in keys]
        return pd.DataFrame([(*first, *c) for c in cues], columns=[*keys, "start", "end", "text"]).astype({"start": "int64", "end": "Int64"})

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return shipped(pairs).groupBy(*keys).applyInPandas(run, f"{kinds}, start long, end long, text string")


def bit_planes(data: Column) -> Column:
    """Eight seven-bit bytes to seven bytes, each bit plane one of them, over all of the data (BINARY of a multiple of eight)."""

    @arrow_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            groups = np.frombuffer(bytes(v)[: len(v) // 8 * 8], np.uint8).reshape(-1, 8)
            planes = (groups[:, None, :] >> np.arange(7)[None, :, None] & 1).astype(np.uint8)
            out.append(np.packbits(planes, axis=2, bitorder="little").tobytes())
        return pd.Series(out)

    return run(data)
