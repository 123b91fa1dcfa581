"""Broadcast data packets of 33 bytes: address, continuity, structure, data groups over packets, and votes over copies of records.

A packet is three address nibbles, a continuity index and a structure nibble, each in a Hamming byte, and 28 bytes of data whose
last 0, 1, 2 or 28 are a check. The structure's lowest bit marks the first packet of a data group, its next one a packet that
isn't full, the two high ones the length of the check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import columns as K
from concord.operators import votes

SUFFIX = (0, 1, 2, 28)


def parse(packets: DataFrame) -> DataFrame:
    """recording, seq, address (0 to 4095), counter, first, full, suffix, data (without the check), check; packets with an unreadable prefix are left out."""
    nib = [K.hamming84(K.byte_at(F.col("packet"), k)).cast("int") for k in range(5)]
    held = packets.filter(F.length("packet") == 33).withColumn("_n", F.array(*nib)).filter(F.forall("_n", lambda x: x >= 0))
    n = [F.col("_n")[k] for k in range(5)]
    suffix = F.element_at(F.lit([*SUFFIX]), F.shiftright(n[4], 2) + 1)
    shaped = held.select("recording", "seq", (n[0] * 256 + n[1] * 16 + n[2]).alias("address"), n[3].alias("counter"), (n[4].bitwiseAND(F.lit(1)) == 1).alias("first"), (n[4].bitwiseAND(F.lit(2)) == 0).alias("full"), suffix.alias("suffix"), F.substring("packet", 6, 28).alias("_d"))
    return shaped.select("recording", "seq", "address", "counter", "first", "full", "suffix", F.substring(F.col("_d"), F.lit(1), 28 - F.col("suffix")).alias("data"), F.substring(F.col("_d"), 29 - F.col("suffix"), F.col("suffix")).alias("check"))


def right_parity(parsed: DataFrame) -> DataFrame:
    """parsed with whole: packets with a check of one byte whose data and check XOR to zero; null for other packets."""
    return parsed.withColumn("whole", F.when(F.col("suffix") == 1, K.xor_all(K.byte_list(F.concat("data", "check"))) == 0))


def data_groups(parsed: DataFrame, keys: Sequence[str] = ("recording", "address")) -> DataFrame:
    """keys, seq (of the first packet), data, packets, gaps: the data of each group from its first packet on; gaps counts packets that the continuity says are missing. Check packets carry no data."""
    w = W.partitionBy(*keys).orderBy("seq")
    step = F.pmod(F.col("counter") - F.lag("counter").over(w), F.lit(16))
    every = parsed.withColumn("_lost", F.when(step > 1, step - 1).when(step == 0, 15).otherwise(0)).withColumn("_g", F.sum(F.col("first").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = every.filter("_g > 0").withColumn("_lost", F.when(F.col("first"), 0).otherwise(F.col("_lost")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"])
    return own.groupBy(*keys, "_g").agg(F.min("seq").alias("seq"), F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x)).alias("data"), F.count("*").alias("packets"), F.sum("_lost").alias("gaps")).drop("_g")


def catalogue(groups: DataFrame, keys: Sequence[str], name: str, data: str = "data", most: int = 8) -> DataFrame:
    """keys, name, data, copies, intact: the best copy of each record: intact and of right parity, then intact, then any; of the best rank the commonest content, ties to the longer and then the smallest. At most `most` copies of a content count."""
    odd = F.forall(K.byte_list(F.col(data)), lambda x: K.odd_parity(x))
    rank = F.when((F.col("gaps") == 0) & odd, 2).when(F.col("gaps") == 0, 1).otherwise(0)
    by = groups.withColumn("_rank", rank).groupBy(*keys, name, "_rank", data).agg(F.least(F.count("*"), F.lit(most)).alias("_n"))
    best = F.min_by(F.struct("_rank", data), F.struct(-F.col("_rank"), -F.col("_n"), -F.length(data), F.hex(data)))
    return by.groupBy(*keys, name).agg(best.alias("_b"), F.sum("_n").alias("copies")).select(*keys, name, F.col(f"_b.{data}").alias(data), "copies", (F.col("_b._rank") > 0).alias("intact"))


def voted_records(groups: DataFrame, keys: Sequence[str], name: str, data: str = "data") -> DataFrame:
    """keys, name, data, copies: byte by byte over all copies of the commonest length, bytes of odd parity before others, ties to the smallest."""
    sized = groups.withColumn("_size", F.length(data))
    size = votes.vote(sized, [*keys, name], "_size").select(*keys, name, "_size", F.col("votes").alias("copies"))
    each = sized.join(size, [*keys, name, "_size"]).select(*keys, name, "copies", F.posexplode(K.byte_list(F.col(data))).alias("place", "byte"))
    won = votes.vote(each, [*keys, name, "copies", "place"], "byte", prefer=K.odd_parity(F.col("byte")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("place", "byte"))), lambda x: F.lpad(F.hex(x["byte"]), 2, "0"))
    return won.groupBy(*keys, name, "copies").agg(F.unhex(F.array_join(joined, "")).alias(data))
