"""Streams in arrays against the same packets one by one."""

import random

import pytest
from pyspark.sql import functions as F

from concord import queries
from concord.functions import codes
from concord.operators import pages, streams

WORDS = [int(x) for x in codes.hamming84_words()]


def packet(rng, magazine, row, page=0, subcode=0):
    text = bytes(codes.with_odd_parity(streams.np.array([rng.choice(b"ab \x05") for _ in range(40)], streams.np.uint8)))
    digits = [magazine & 7 | (row & 1) << 3, row >> 1] + ([page & 15, page >> 4, subcode & 15, subcode >> 4 & 7, subcode >> 8 & 15, subcode >> 12 & 3, 0, 0] if row == 0 else [])
    raw = bytearray(bytes(WORDS[d] for d in digits) + text)[:42]
    for _ in range(rng.choice([0, 0, 1, 2])):
        raw[rng.randrange(42)] ^= 1 << rng.randrange(8)
    return bytes(raw)


def made(seed, packets, magazines=(1, 8), pages_=(0, 1, 255), rows=(0, 0, 1, 2, 2, 24, 26)):
    rng = random.Random(seed)
    return [packet(rng, rng.choice(magazines), rng.choice(rows), rng.choice(pages_), rng.choice([0, 0, 5])) for _ in range(packets)]


@pytest.mark.parametrize("least", [None, 3])
def test_arrays_do_what_packets_do(spark, least, monkeypatch):
    monkeypatch.setattr(streams, "BATCH", streams.BATCH | {"spark.sql.execution.arrow.maxRecordsPerBatch": "3"})
    sent = {r: made(r, 60 + 40 * r) for r in range(6)} | {6: [], 7: made(7, 400, (3,), (16,), (0, 1))}
    one = spark.createDataFrame([(r, k, p) for r, every in sent.items() for k, p in enumerate(every)], "recording long, seq long, packet binary")
    rows = pages.paginate(pages.parse(one))
    key = ("magazine", "page", "subcode") if least else ("recording", "magazine", "page", "subcode")
    mine = () if least else ("recording",)
    voted = pages.vote_pages(pages.quorum_pages(rows, least) if least else rows, key)
    held = streams.short(spark.createDataFrame([(r, b"".join(every) + b"cut off") for r, every in sent.items()], "recording long, data binary"))
    sets = streams.page_sets(held, mine)
    columns = [*key, "row", "text", "least"]
    want, got = (sorted(map(str, df.select(columns).collect())) for df in (voted, streams.vote_pages(sets, mine, least)))
    assert len(want) > 9 and got == want
    want, got = (sorted(map(str, df.select(*key, "text").collect())) for df in (pages.page_text(voted, key), streams.page_text(sets, mine, least)))
    assert want and got == want


def test_streams_of_texts_are_packets_of_pages(spark):
    text = "".join(chr(32 + k % 95) for k in range(24 * 40 * 9 + 41))
    got = bytes(streams.of_texts(spark.createDataFrame([(1, None), (2, "é\n"), (3, text)], "k long, t string"), "k", "t").first().data)
    lines = [(k // 24, k % 24 + 1, text[40 * k : 40 * k + 40]) for k in range(24 * 9 + 2)]
    one = spark.createDataFrame([(1 + n % 8, n // 8, 0, r, t) for n, r, t in lines], "magazine int, page int, subcode int, row int, text string")
    assert sorted(got[k : k + 42] for k in range(0, len(got), 42)) == sorted(bytes(r.packet) for r in pages.to_packets(one).collect())


def test_every_text_packet_is_bent_in_one_copy(spark):
    one = streams.of_texts(spark.createDataFrame([(k, "some words " * 200) for k in range(3)], "k long, t string"), "k", "t")
    got = streams.bent(one).groupBy("recording").agg(F.collect_list("data").alias("d")).collect()
    clean = bytes(one.first().data)
    for r in got:
        for at in range(0, len(clean), 42):
            wrong = [i for d in r.d for i in range(42) if d[at + i] != clean[at + i]]
            assert len(r.d) == 5 and len(wrong) == (at % (25 * 42) > 0) and all(i >= 2 for i in wrong)


@pytest.mark.parametrize("name", ["D01_rt_pages", "K06_page_text"])
def test_no_packet_is_a_row(spark, tmp_path, name):
    """A row for each packet, and windows over them, took too long for a gigabyte of texts."""
    spark.createDataFrame([(1, "some words " * 200)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "MapInArrow" in plan
