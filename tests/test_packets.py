"""Packet files, pages and their streaming twin, on streams made here."""

import random

import pytest
from pyspark.sql import functions as F

from concord.functions import codes
from concord.operators import pages
from concord.sources import packets
from concord.streaming import live

LINES = {(1, 0x00, 1): ["FIRST PAGE", "with some text 1"], (1, 0x01, 0): ["SECOND", "row two", "row three"], (8, 0x88, 2): ["EIGHT", "z" * 40]}


def page_rows(spark):
    return spark.createDataFrame([(m, p, s, r + 1, t.ljust(40)) for (m, p, s), lines in LINES.items() for r, t in enumerate(lines)], "magazine int, page int, subcode int, row int, text string")


def clean_stream(spark, copies=5, damage=0.0, seed=1):
    one = [(r.seq, bytes(r.packet)) for r in pages.to_packets(page_rows(spark)).orderBy("seq").collect()]
    rng, out = random.Random(seed), []
    for _ in range(copies):
        for _, raw in one:
            raw = bytearray(raw)
            if rng.random() < damage:  # never the header: its page would be lost, not bent
                k = rng.randrange(2, 42)
                if codes.hamming84_table()[raw[0]] & 8 or codes.hamming84_table()[raw[1]]:
                    raw[k] ^= 1 << rng.randrange(8)
            out.append(bytes(raw))
    return out


@pytest.fixture
def files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"rec{k}.t42").write_bytes(b"".join(clean_stream(spark, damage=0.2, seed=k)) + b"cut off")
    return str(tmp_path)


def test_source_splits_and_samples(spark, files):
    n = len(clean_stream(spark))
    df = packets.read_packets(spark, files, split=7)
    assert df.rdd.getNumPartitions() > 4 and df.count() == 2 * n
    assert packets.read_packets(spark, files + "/rec0.t42", step=5).select("seq").orderBy("seq").collect()[1].seq == 5
    seqs = [r.seq for r in df.filter(F.col("recording").endswith("rec1.t42")).orderBy("seq").collect()]
    assert seqs == list(range(n))


def test_frames_and_layouts(spark, tmp_path):
    (tmp_path / "a.vbi").write_bytes(bytes(range(240)))
    got = packets.frames(packets.read_packets(spark, str(tmp_path / "a.vbi"), 20), 4).collect()
    assert [(r.frame, r.line, r.samples[0]) for r in sorted(got, key=lambda r: r.samples[0])] == [(k // 4, k % 4, 20 * k) for k in range(12)]
    layouts = spark.createDataFrame([("x", 80), ("y", 7), ("z", 0)], "name string, frame_bytes int")
    assert [r.name for r in packets.layouts_that_fit(layouts, 240).collect()] == ["x"]


def test_written_streams_read_back(spark, tmp_path):
    df = pages.to_packets(page_rows(spark))
    assert packets.write_packets(df, str(tmp_path / "out"))
    back = packets.read_packets(spark, str(tmp_path / "out")).orderBy("recording", "seq").collect()
    assert [bytes(r.packet) for r in back] == [bytes(r.packet) for r in df.orderBy("seq").collect()]


def test_pages_are_voted_out_of_damage(spark, files):
    parsed = pages.parse(packets.read_packets(spark, files))
    rows = pages.paginate(parsed)
    voted = pages.vote_pages(pages.quorum_pages(rows))
    got = {(r.magazine, r.page, r.subcode, r.row): r.text for r in voted.collect() if r.row}
    assert got == {(m, p, s, k + 1): t.ljust(40) for (m, p, s), lines in LINES.items() for k, t in enumerate(lines)}
    text = {(r.magazine, r.page, r.subcode): r.text for r in pages.page_text(voted).collect()}
    assert text == {k: "\n".join(lines) for k, lines in LINES.items()}
    assert sum(r.copies for r in pages.versions(rows).collect()) == 2 * 5 * 3
    q = pages.quality(parsed).collect()
    assert len(q) == 2 and all(r.wrong > 0 for r in q)


def test_unreadable_and_filler_headers(spark):
    def stream(*codes_):
        parts = []
        for k, (kind, page) in enumerate(codes_):
            parts.append(spark.range(1).select(F.lit("r").alias("recording"), F.lit(k).cast("long").alias("seq"), (pages.header(F.lit(1), F.lit(page), F.lit(0), F.lit("HEAD")) if kind == "h" else pages.text_row(F.lit(1), F.lit(page), F.lit("text"))).alias("packet")))
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        return every

    got = pages.paginate(pages.parse(stream(("t", 3), ("h", 0x12), ("h", 0x13), ("t", 1), ("t", 1), ("h", 255), ("t", 2)))).orderBy("seq").collect()
    assert [(r.page, r.row, r.seq) for r in got] == [(0x13, 0, 2), (0x13, 1, 4)]
    empty = spark.createDataFrame([], "recording string, seq long, packet binary")
    assert pages.paginate(pages.parse(empty)).count() == 0


def test_subtitles(spark):
    head = pages.header(F.lit(8), F.lit(0x88), F.lit(0), F.lit("SUB"), F.lit(4))
    row = pages.text_row(F.lit(8), F.lit(20), F.col("t"))
    cues = [("Hello there", 0), ("", 50), ("Bye", 100)]
    parts = [spark.createDataFrame([("r", at + k, t)], "recording string, seq long, t string").select("recording", "seq", (head if k == 0 else row).alias("packet")) for t, at in cues for k in (0, 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    found = pages.subtitles(pages.paginate(pages.parse(every)), F.col("seq") / 25)
    got = sorted((r.start, r.end, r.text) for r in found.collect())
    assert got == [(0.0, 2.0, "Hello there"), (4.0, 11.0, "Bye")]
    assert pages.subrip(found, ["page"]).first().srt == "1\n00:00:00,000 --> 00:00:02,000\nHello there\n\n2\n00:00:04,000 --> 00:00:11,000\nBye\n"


def test_stream_equals_batch(spark, files, tmp_path):
    table = packets.read_packets(spark, files)
    for k in range(4):  # a folder that grows, each file later in time
        lo, hi = k * 12, (k + 1) * 12 if k < 3 else 10**9
        table.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closed = live.closed_pages(live.follow(spark, str(tmp_path / "in"), "recording string, seq long, packet binary", 1))
    closed.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = pages.paginate(pages.parse(table))
    last = batch.groupBy("recording", "magazine").agg(F.max("tx").alias("last"))  # open until another header comes
    want = batch.join(last, ["recording", "magazine"]).filter("tx < last").select("recording", "magazine", "tx", "seq", "page", "subcode", "row", F.hex("payload").alias("p"))
    got = spark.table("closed").select("recording", "magazine", "tx", "seq", "page", "subcode", "row", F.hex("payload").alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20


def test_store_votes(spark):
    store = live.PageStore(spark)
    kinds = "recording string, magazine int, tx long, seq long, page int, subcode int, control int, row int, payload binary"
    read = lambda seq, p: ("r", 1, seq, seq, 5, None, None, 1, bytearray(p))
    store.merge(spark.createDataFrame([read(1, b"old"), read(2, b"old"), read(3, b"bad")], kinds), 0)
    assert bytes(store.snapshot().first().payload) == b"old"
    store.merge(spark.createDataFrame([read(4, b"new"), read(5, b"new"), read(6, b"new")], kinds), 1)
    store.merge(spark.createDataFrame([read(4, b"new")], kinds), 1)  # the same batch again
    row = store.snapshot().first()
    assert bytes(row.payload) == b"new" and row.seen == 6
    store.expire()
    assert store.snapshot().count() == 1


def test_event_time_windows(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", "a" if k % 3 else "b") for k in range(0, 40)]
    spark.createDataFrame(rows, "n int, t string, kind string").select("n", F.to_timestamp("t").alias("t"), "kind").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = live.follow(spark, str(tmp_path / "e"), "n int, t timestamp, kind string")
    for name, df in {"tumble": live.tumbling(stream, "t", "10 minutes", "1 minute", n=F.count("*")), "slide": live.sliding(stream, "t", "10 minutes", "5 minutes", "1 minute", ["kind"]), "sess": live.sessions(stream, "t", "90 seconds", "1 minute", ["kind"]), "uniq": live.first_seen(stream, "t", "1 minute", ["kind"])}.items():
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("tumble").collect()) == [10, 10, 10]
    assert spark.table("slide").count() > 8 and spark.table("uniq").count() == 2
    assert {r.n for r in spark.table("sess").filter("kind = 'a'").collect()} == {2}
