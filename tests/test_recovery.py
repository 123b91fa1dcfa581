"""Recovery of headers, subcodes, links and full rows."""

import numpy as np
from pyspark.sql import functions as F

from concord.functions import codes
from concord.operators import recovery


def test_an_unreadable_header_is_the_usual_next_page(spark):
    pages = [1, 2, 3] * 3 + [1, None, 3, None]
    rows = [("r", 1, 10 * k, 0, p) for k, p in enumerate(pages)] + [("r", 1, 10 * k + 1, 1, None) for k in range(len(pages))]
    df = spark.createDataFrame(rows, "recording string, magazine int, seq long, row int, page int")
    got = [r.page for r in recovery.recover_headers(df).filter("row = 0").orderBy("seq").collect()]
    assert got == [1, 2, 3] * 4 + [1]


def test_orphans_go_to_the_page_that_has_their_rows(spark):
    rows = [("p", r, t) for r, t in enumerate("abcdef")] + [("q", r, t) for r, t in enumerate("axyzef")]
    loose = [(1, r, t) for r, t in enumerate("abcd")] + [(2, 0, "a"), (2, 4, "e"), (2, 5, "f")] + [(3, 1, "x")]
    got = recovery.own_orphans(spark.createDataFrame(rows, "page string, row int, text string"), spark.createDataFrame(loose, "orphan int, row int, text string"), ["page"], "row", "text")
    assert [(r.orphan, r.page, r.n) for r in got.collect()] == [(1, "p", 4)]


def test_subcodes_by_content_or_by_the_last(spark):
    rows, seq = [], 0

    def send(tx, sub, texts):
        nonlocal seq
        for r, t in enumerate(["head", *texts]):
            rows.append(("r", 1, 5, tx, seq, sub, r, bytearray(t.encode())))
            seq += 1

    for k in range(3):
        send(2 * k, 1, ["one", "same"])
        send(2 * k + 1, 2, ["two", "same"])
    send(6, None, ["one", "same"])
    send(7, None, ["???", "!!!"])
    df = spark.createDataFrame(rows, "recording string, magazine int, page int, tx int, seq long, subcode int, row int, payload binary")
    got = {r.tx: r.subcode for r in recovery.assign_subcodes(df).filter("tx >= 6").collect()}
    assert got == {6: 1, 7: 2}


def test_counters_make_rotations(spark):
    df = spark.createDataFrame([("p", "News 01/03")] * 3 + [("p", "News 02/03")] * 4 + [("p", "01/02/03"), ("p", "09/03")] + [("q", "01/02")] * 5, "page string, text string")
    c = recovery.counters(df, ["page"], "text")
    assert sorted((r.part, r.parts) for r in c.filter("part IS NOT NULL").distinct().collect() if r.page == "p") == [(1, 3), (2, 3)]
    assert sorted(map(tuple, recovery.rotations_by_counter(c, ["page"]).collect())) == [("p", 1, 3), ("p", 2, 4)]


def test_content_groups(spark):
    contents = [list("abcde")] * 6 + [list("abcdX")] * 2 + [list("pqrst")] * 3 + [list("vwxyz")]
    df = spark.createDataFrame([("p", k, r, t) for k, c in enumerate(contents) for r, t in enumerate(c)], "page string, copy int, row int, text string")
    got = {r.copy: (r.group, r.weight) for r in recovery.content_groups(df, ["page"], "copy", "row", "text").collect()}
    assert len({got[k] for k in range(8)}) == 1 and got[0][1] == 8 and got[8][1] == 3 and 11 not in got


def test_full_rows_prefer_a_neighbourhood(spark):
    rows = [("p", 1, "HELLO WORLD", 1), ("p", 1, "HELLO WORLX", 2), ("p", 1, "HELLP WORLD", 3), ("p", 1, "0123456789", 4), ("p", 1, "0123456789", 5)]
    got = recovery.full_rows(spark.createDataFrame(rows, "page string, row int, text string, at int"), ["page"], "row", "text", "at", most=2).first()
    assert (got.text, got.weight) == ("HELLP WORLD", 3)


def test_links(spark):
    def nibbles(magazine, page, sub, own):
        flips = (magazine % 8) ^ (own % 8)
        return [page & 15, page >> 4, sub & 15, (sub >> 4 & 7) | (flips & 1) << 3, sub >> 8 & 15, (sub >> 12 & 3) | (flips >> 1) << 2]

    n = [0]
    for m, p, s in ((3, 0x45, 0x3F7F), (8, 0x88, 1), (1, 0xFF, 0), (1, 0x12, 0x1234 & 0x3F7F), (1, 0xFF, 0), (1, 0xFF, 0)):
        n += nibbles(m, p, s, 1)
    payload = bytearray(codes.encode_hamming84(np.array(n)).tobytes()).ljust(40, b"\x15")
    df = spark.createDataFrame([("r", 1, 1, 27, payload), ("r", 2, 1, 26, payload)], "recording string, seq long, magazine int, row int, payload binary")
    got = [(r.magazine, r.place, r.page, r.subcode) for r in recovery.links(df).orderBy("place").collect()]
    assert got == [(3, 0, 0x45, 0x3F7F), (8, 1, 0x88, 1), (1, 3, 0x12, 0x1234 & 0x3F7F)]


def test_titles_and_charsets(spark):
    heads = spark.createDataFrame([("p", "P100 NEWS 12:30:01"), ("p", "P100 NEWS 12:31:59"), ("p", "P100 NxWS 12:32")], "page string, text string")
    assert recovery.title(heads, ["page"], "text").first().title == "NEWS"
    german, english = {0x5B: "Ä", 0x5D: "Ü", 0x7B: "ä", 0x7D: "ü"}, {0x23: "£"}
    df = spark.createDataFrame([("p", bytearray(b"wir w{ren m}de f}r heute"))], "page string, data binary")
    assert recovery.guess_charset(df, ["page"], "data", {"german": german, "english": english}, ["wären", "müde", "für", "wir"]).first().charset == "german"
