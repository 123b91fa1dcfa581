"""Data groups over 33-byte packets."""

import numpy as np

from concord.functions import codes
from concord.operators import groups


def packet(address, counter, structure, data):
    head = codes.encode_hamming84(np.array([address >> 8, address >> 4 & 15, address & 15, counter % 16, structure])).tobytes()
    return bytearray(head + data.ljust(28, b"\0"))


def stream(spark, rows):
    return spark.createDataFrame([("r", k, p) for k, p in enumerate(rows)], "recording string, seq long, packet binary")


def with_check(data):
    body = data.ljust(27, b" ")[:27]
    x = 0
    for b in body:
        x ^= b
    return body + bytes([x])


def test_packets_and_groups(spark):
    rows = [packet(0x123, 5, 0b0100, with_check(b"lost start"))]
    rows += [packet(0x123, 14, 0b0101, with_check(b"first")), packet(0x7, 0, 1, b"other"), packet(0x123, 15, 0b0100, with_check(b"second")), packet(0x123, 16, 0b0110, with_check(b"third"))]
    rows += [packet(0x123, 1, 0b0101, with_check(b"next")), packet(0x123, 4, 0b0100, with_check(b"after a gap"))]
    bad = packet(0x123, 5, 0b0100, with_check(b"x"))
    bad[0] ^= 0b11
    parsed = groups.parse(stream(spark, [*rows, bad, bytearray(b"short")]))
    assert parsed.count() == len(rows)
    assert {r.whole for r in groups.right_parity(parsed.filter("address = 291")).collect()} == {True}
    got = groups.data_groups(parsed.filter("address = 291")).orderBy("seq").collect()
    assert [(r.seq, r.packets, r.gaps, bytes(r.data).split()) for r in got] == [(1, 3, 0, [b"first", b"second", b"third"]), (5, 2, 2, [b"next", b"after", b"a", b"gap"])]


def test_catalogue_prefers_whole_copies(spark):
    good = codes.with_odd_parity(np.frombuffer(b"HELLO", np.uint8)).tobytes()
    rows = [("a", good, 0), ("a", good, 0), ("a", b"longer but gapped", 1), ("a", bytes([good[0] ^ 1]) + good[1:], 0), ("b", b"\x01\x02", 2)]
    df = spark.createDataFrame([("r", n, bytearray(d), g) for n, d, g in rows], "recording string, name string, data binary, gaps int")
    got = {r.name: (bytes(r.data), r.copies, r.intact) for r in groups.catalogue(df, ["recording"], "name").collect()}
    assert got["a"][0] == good and got["a"][2] and got["b"] == (b"\x01\x02", 1, False)


def test_votes_prefer_right_parity(spark):
    good = codes.with_odd_parity(np.frombuffer(b"RECORD", np.uint8)).tobytes()
    bent = bytes([good[0] ^ 4]) + good[1:]  # wrong parity, in most copies
    rows = [bent, bent, bent, good, good[:3] + bytes([good[3] ^ 6]) + good[4:], b"short"]
    df = spark.createDataFrame([("r", "n", bytearray(d)) for d in rows], "recording string, name string, data binary")
    r = groups.voted_records(df, ["recording"], "name").first()
    assert bytes(r.data) == good and r.copies == 5
