"""Data services on records made here."""

import random
import zlib

import numpy as np

from concord.functions import codes
from concord.operators import datacast
from pyspark.sql import functions as F


def test_a_check_with_an_unknown_part_is_learnt(spark):
    rng, rows = random.Random(1), []
    for k in range(12):
        p = rng.randbytes(20)
        c = int(codes.crc(np.frombuffer(p, np.uint8)[None], 32, 0x04C11DB7)[0]) ^ 0xABCD1234
        rows.append(("h", k, bytearray(p), c if k % 4 else c ^ (1 << k)))
    rows.append(("one", 99, bytearray(b"x" * 20), 5))
    got = {r.seq: r.good for r in datacast.learnt_check(spark.createDataFrame(rows, "key string, seq int, payload binary, sent long"), ["key"], "payload", "sent").collect()}
    assert got == {**{k: bool(k % 4) for k in range(12)}, 99: False}


def test_continuity(spark):
    rows = [("a", k, i) for k, i in enumerate([14, 15, 0, 0, 3])]
    got = datacast.with_continuity(spark.createDataFrame(rows, "key string, seq int, ci int"), ["key"], "seq", "ci").orderBy("seq").collect()
    assert [(r.lost, r.repeated) for r in got] == [(0, False), (0, False), (0, False), (0, True), (2, False)]


def test_an_index_that_is_only_in_the_check(spark):
    rows = []
    for k in range(6):
        d = bytes([k, 7, 9])
        s = int(codes.crc(np.frombuffer(d, np.uint8)[None], 16, 0x1021)[0]) ^ ((250 + k) % 256 * 257)
        rows.append(("a", k, bytearray(d), s ^ (1 if k == 2 else 0x0101 << 1 ^ 4 if k == 4 else 0)))
    got = datacast.implied_index(spark.createDataFrame(rows, "key string, seq int, data binary, sent int"), ["key"], "seq", "data", "sent").orderBy("seq").collect()
    assert [(r["index"], r.good) for r in got][:4] == [(250, True), (251, True), (252, True), (253, True)] and not got[4].good and got[5]["index"] == 255


def test_records_cut_at_line_ends(spark):
    rng, rows = random.Random(2), []
    whole = [rng.randbytes(30) for _ in range(8)]
    for k in range(10):
        tail = bytearray(whole[k][:18]) if k < 8 else None
        head = bytearray(whole[k - 2][18:]) if k >= 2 else bytearray(b"?")
        rows.append(("s", k, tail, head, zlib.crc32(whole[k]) if k < 8 else 0))
    df = spark.createDataFrame(rows, "key string, seq long, tail binary, head binary, crc long")
    assert [tuple(r) for r in datacast.continuations(df, ["key"], "seq", "tail", "head", "crc").collect()] == [("s", 2)]


def test_resent_items(spark):
    rng = random.Random(3)
    base = bytes(rng.randrange(32, 126) for _ in range(500))
    near = bytearray(base)
    for k in rng.sample(range(400), 30):
        near[k] ^= 1
    far = bytes(rng.randrange(32, 126) for _ in range(500))
    rows = [(1, bytearray(base)), (2, near), (3, bytearray(far)), (4, bytearray(base[:-1]))]
    assert [tuple(r) for r in datacast.resent(spark.createDataFrame(rows, "id long, data binary"), "id", "data").collect()] == [(1, 2)]


def test_captions(spark):
    def text(s):
        raw = s.encode() + b"\0" * (len(s) % 2)
        return list(zip(raw[::2], raw[1::2], strict=True))

    twice = lambda a, b: [(a, b), (a, b)]
    pop = twice(0x14, 0x20) + twice(0x14, 0x2E) + twice(0x13, 0x40) + text("HELLO") + twice(0x14, 0x40) + text("WORLD!") + twice(0x14, 0x2F) + [(0, 0)] * 5 + twice(0x14, 0x2C)
    roll = twice(0x14, 0x25) + twice(0x14, 0x2D) + text("ONE") + twice(0x14, 0x2D) + text("TWO")
    rows = [("f", k, a, b) for k, (a, b) in enumerate(pop + roll)]
    got = sorted((r.start, r.end, r.text) for r in datacast.captions(spark.createDataFrame(rows, "field string, seq long, a int, b int"), ["field"]).collect())
    at = next(k for k, p in enumerate(pop) if p == (0x14, 0x2F))
    assert got[0] == (at, at + 7, "HELLO\nWORLD!") and got[-1][2].endswith("TWO") and "ONE" in got[-1][2] and got[-1][1] is None


def test_bit_planes(spark):
    raw = bytes(range(7))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(7, 1), axis=1, bitorder="little")
    sent = (bits * (1 << np.arange(7))[:, None]).sum(axis=0).astype(np.uint8).tobytes()
    assert bytes(spark.createDataFrame([(bytearray(sent),)], "d binary").select(datacast.bit_planes(F.col("d"))).first()[0]) == raw
