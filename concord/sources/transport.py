"""Transport streams: packet headers, continuity, reassembled payloads, and the teletext in them.

packets: recording, seq, packet of 188 bytes, as read_packets(size=188) gives them. Reassembly is keyed by recording and PID.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import columns as K
from concord.plans.work import ship

#: Bits of a byte in the other order.
FLIP = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint8)


def headers(packets: DataFrame) -> DataFrame:
    """recording, seq, pid, start (of a payload unit), scrambled, counter, body (the payload; empty where there is none); packets without the sync byte, or flagged as wrong, are left out."""
    b = lambda k: K.byte_at(F.col("packet"), k)
    fine = (F.length("packet") == 188) & (b(0) == 0x47) & (b(1).bitwiseAND(F.lit(0x80)) == 0)
    h = packets.filter(fine).select("recording", "seq", "packet", (b(1).bitwiseAND(F.lit(31)) * 256 + b(2)).alias("pid"), (b(1).bitwiseAND(F.lit(0x40)) > 0).alias("start"), F.shiftright(b(3), 6).alias("scrambled"), F.shiftright(b(3), 4).bitwiseAND(F.lit(3)).alias("_f"), b(3).bitwiseAND(F.lit(15)).alias("counter"), b(4).alias("_n"))
    skip = F.when(F.col("_f") == 3, F.col("_n") + 5).otherwise(4)
    body = F.when(F.col("_f").bitwiseAND(F.lit(1)) == 1, F.substring(F.col("packet"), skip + 1, F.lit(188))).otherwise(F.lit(b""))
    return h.select("recording", "seq", "pid", "start", "scrambled", "counter", body.alias("body"))


def continuity(heads: DataFrame) -> DataFrame:
    """recording, pid, packets, lost, repeated: breaks of the counter of each PID."""
    w = W.partitionBy("recording", "pid").orderBy("seq")
    step = F.pmod(F.col("counter") - F.lag("counter").over(w), F.lit(16))
    return heads.filter("length(body) > 0").withColumn("_s", step).groupBy("recording", "pid").agg(F.count("*").alias("packets"), F.sum(F.when(F.col("_s") > 1, F.col("_s") - 1).otherwise(0)).alias("lost"), F.count_if(F.col("_s") == 0).alias("repeated"))


def units(heads: DataFrame) -> DataFrame:
    """recording, pid, seq (of its first packet), data: whole payload units; what comes before the first start is left out, and packets that were sent twice count once."""
    w = W.partitionBy("recording", "pid").orderBy("seq")
    once = heads.filter("length(body) > 0 AND scrambled = 0").withColumn("_p", F.lag("counter").over(w)).filter("_p IS NULL OR _p <> counter")
    numbered = once.withColumn("_u", F.sum(F.col("start").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_u > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"])
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x))
    return numbered.groupBy("recording", "pid", "_u").agg(F.min("seq").alias("seq"), joined.alias("data")).drop("_u")


def teletext(payloads: DataFrame) -> DataFrame:
    """recording, pid, seq, packet (42 bytes): the teletext data units of private payloads, each byte's bits turned round; seq counts units of a payload in the lower bits."""
    ship(payloads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"recording": [], "pid": [], "seq": [], "packet": []}
            for row in batch.to_pylist():
                raw = row["data"] or b""
                if len(raw) < 10 or raw[:4] != b"\0\0\1\xbd":
                    continue
                at, k = 9 + raw[8] + 1, 0  # after the header comes one byte that says what data these are
                while at + 2 <= len(raw):
                    kind, size = raw[at], raw[at + 1]
                    if kind in (0x02, 0x03) and size == 44 and at + 46 <= len(raw):
                        out["recording"].append(row["recording"])
                        out["pid"].append(row["pid"])
                        out["seq"].append(row["seq"] * 256 + k)
                        out["packet"].append(FLIP[np.frombuffer(raw, np.uint8, 42, at + 4)].tobytes())
                        k += 1
                    at += 2 + size
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("recording", pa.string()), ("pid", pa.int32()), ("seq", pa.int64()), ("packet", pa.binary())]))

    return payloads.select("recording", "pid", "seq", "data").mapInArrow(run, "recording string, pid int, seq long, packet binary")
