"""The streaming twin: pages closed as packets arrive, a page store with decaying votes, windows over event time.

Packets come in order of seq within a recording. Open transmissions are keyed state; closed ones are merged into the store a
micro-batch at a time, so a batch that is run again gives the same store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concord.operators import pages
from concord.plans.work import cut_small, drop, ship

CLOSED = "recording string, magazine int, tx long, seq long, page int, subcode int, control int, row int, payload binary"
#: What a read value gains, the most it can have, candidates a row keeps; a subpage unseen for 4 n + 40 transmissions goes.
GAIN, MOST, CANDIDATES, PATIENCE = 2, 6, 3, 40


def closed_pages(packets: DataFrame) -> DataFrame:
    """The rows of each transmission, when the next header of its magazine closes it. packets: a stream of recording, seq, packet."""
    ship(packets.sparkSession)
    parsed = pages.parse(packets).filter("row <= 24")

    def close(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tx, head, rows = state.get if state.exists else (0, None, [])
        rows, out = list(rows or []), []
        every = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for seq, row, payload, page, sub, control in zip(every["seq"], every["row"], every["payload"], every["page"], every["subcode"], every["control"], strict=True):
            if row == 0:
                out += finished(key, tx, head, rows)
                tx, rows = tx + 1, []
                head = None if pd.isna(page) else (int(page), -1 if pd.isna(sub) else int(sub), -1 if pd.isna(control) else int(control))
            rows.append((int(seq), int(row), bytes(payload)))
        state.update((tx, head, rows))
        yield pd.DataFrame(out, columns=["recording", "magazine", "tx", "seq", "page", "subcode", "control", "row", "payload"]).astype({"subcode": "Int32", "control": "Int32"})

    state = "tx long, head struct<page:int,subcode:int,control:int>, rows array<struct<seq:bigint,row:int,payload:binary>>"
    return parsed.groupBy("recording", "magazine").applyInPandasWithState(close, CLOSED, state, "append", GroupStateTimeout.NoTimeout)


def finished(key: tuple, tx: int, head, rows: list) -> list[tuple]:
    """The rows of a transmission, as in a batch: a header that can be read, not the filler, and one more packet; of a row sent twice the last."""
    if head is None or head[0] == 255 or len(rows) < 2:
        return []
    last = {r[1]: r for r in rows}
    clean = lambda v: None if v is None or v < 0 else v
    return [(*key, tx, seq, head[0], clean(head[1]), clean(head[2]), row, payload) for seq, row, payload in sorted(last.values())]


class PageStore:
    """Pages as far as they are known: for each row of a page up to three candidates with votes.

    A value that is read gains two votes, up to six, and the others lose one; the candidate with the most is shown. Use with
    writeStream.foreachBatch(store.merge); snapshot() is the view at any time. The store is a table that each batch replaces.
    """

    KEYS = ("magazine", "page", "subcode", "row")
    SCHEMA = "magazine int, page int, subcode int, row int, seen long, candidates array<struct<payload:binary,votes:int>>"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.table = spark.createDataFrame([], self.SCHEMA)
        self.done: set[int] = set()

    def merge(self, batch: DataFrame, number: int = 0) -> None:
        if number in self.done:
            return
        keys = list(self.KEYS)
        rows = batch.select(*self.KEYS, "recording", "seq", "payload").withColumn("subcode", F.coalesce("subcode", F.lit(-1)))

        def update(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            held = [(bytes(c["payload"]), int(c["votes"])) for c in (old["candidates"].iloc[0] if len(old) else [])]
            seen = int(old["seen"].iloc[0]) if len(old) else 0
            for payload in new.sort_values(["recording", "seq"])["payload"].map(bytes):
                seen += 1
                held = voted(held, payload)
            return pd.DataFrame([(*key, seen, [{"payload": p, "votes": v} for p, v in held])], columns=[*keys, "seen", "candidates"])

        ship(self.spark)
        merged = self.table.groupBy(*self.KEYS).cogroup(rows.groupBy(*self.KEYS)).applyInPandas(update, self.SCHEMA)
        old, self.table = self.table, cut_small(merged, f"pages-{number}")
        drop(old)
        self.done.add(number)

    def snapshot(self) -> DataFrame:
        """magazine, page, subcode, row, payload, votes, seen: the leading candidate of every row."""
        best = F.element_at("candidates", 1)
        return self.table.select(*self.KEYS, best["payload"].alias("payload"), best["votes"].alias("votes"), "seen")

    def expire(self) -> None:
        """Forget subpages that their page's other subpages have long overtaken."""
        n = self.table.filter("row = 0").groupBy("magazine", "page").agg(F.count("*").alias("_n"), F.max("seen").alias("_top"))
        kept = self.table.join(n, ["magazine", "page"], "left").filter(F.col("_top").isNull() | (F.col("_top") - F.col("seen") <= 4 * F.col("_n") + PATIENCE))
        old, self.table = self.table, cut_small(kept.drop("_n", "_top"), "pages-kept")
        drop(old)


def voted(held: list[tuple[bytes, int]], payload: bytes) -> list[tuple[bytes, int]]:
    """Candidates after one more reading, best first; of equal votes the older stays ahead."""
    known = any(p == payload for p, _ in held)
    out = [(p, min(MOST, v + GAIN)) if p == payload else (p, v - 1) for p, v in held]
    if not known:
        out = sorted(out, key=lambda c: -c[1])[: CANDIDATES - 1] + [(payload, GAIN)]
    return [c for c in sorted(out, key=lambda c: -c[1]) if c[1] > 0 or c[0] == payload]


def tumbling(stream: DataFrame, at: str, width: str, late: str, **aggregates: Column) -> DataFrame:
    """window_start and aggregates of each stretch of event time; rows later than `late` are dropped."""
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("_w.start").alias("window_start"), *aggregates)


def sliding(stream: DataFrame, at: str, width: str, step: str, late: str, keys: list[str]) -> DataFrame:
    """window_start, keys, n: counts in overlapping windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """keys, first, end, n of runs without a pause of `gap`."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("_s"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("_s.start").alias("first"), F.col("_s.end").alias("end"), "n")


def first_seen(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """The stream without repeats of its keys within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def follow(spark: SparkSession, folder: str, schema: str, files: int = 4) -> DataFrame:
    """A folder that grows, a few files a batch: a slow reader falls behind, and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
