"""Services: labels, signalling, time codes, extended data, files from blocks."""

import base64
import datetime

from pyspark.sql import functions as F

from concord import service_queries
from concord.functions import codes
from concord.operators import services


def test_programme_labels(spark):
    df = spark.createDataFrame([(24, 12, 20, 15, 0xD8F, 7), (1, 1, 0, 0, 0x3C1, 255)], "d int, m int, h int, n int, c int, p int")
    got = df.withColumn("l", services.programme_label(services.make_label(*map(F.col, "dmhncp")))).select("*", "l.*", services.plausible_label(F.col("l")).alias("ok")).collect()
    assert all((r.d, r.m, r.h, r.n, r.c, r.p) == (r.day, r.month, r.hour, r.minute, r.cni, r.pty) and r.ok for r in got)


def test_signalling(spark):
    df = spark.createDataFrame([(0b0111,), (0b0110,), (0b10000000001000,)], "w int").select(services.signalling(F.col("w")).alias("s"))
    a, b, c = (r.s for r in df.collect())
    assert a.aspect == "16:9 full" and not a.film and b is None and c.aspect == "4:3 full" and c.copy_restricted


def test_monitor_words(spark):
    body = 0b10110 << 36 | 123456789 << 1
    word = 0b1010110 << 41 | body
    word |= (bin(body).count("1") + 1) % 2
    df = spark.createDataFrame([(word,), (word ^ 4,), (word ^ 1 << 47,)], "w long").select(services.monitor_word(F.col("w")).alias("m"))
    a, b, c = (r.m for r in df.collect())
    assert (a.address, a.payload, a.parity_ok) == (0b10110, 123456789, True) and not b.parity_ok and c is None


def test_time_code_lines(spark):
    line = services.make_time_code_line(23, 59, 58, 24, True, 0xDEADBEEF)
    bent = line[:30] + ("1" if line[30] == "0" else "0") + line[31:]
    wrong = line[:33] + ("1" if line[33] == "0" else "0") + line[34:]
    got = [r.t for r in spark.createDataFrame([(line,), (bent,), (wrong,), ("01",), (None,)], "l string").select(services.time_code_line(F.col("l")).alias("t")).collect()]
    assert tuple(got[0]) == (23, 59, 58, 24, True, 0xDEADBEEF)
    assert all(g is None or g.h is None for g in got[1:])


def test_service_information(spark):
    p = bytearray(40)
    p[7], p[8] = int(f"{0x12:08b}"[::-1], 2), int(f"{0x34:08b}"[::-1], 2)
    p[9] = 2 << 1 | 0x40
    digits = [int(d) + 1 for d in "45218"]
    p[10], p[11], p[12] = digits[0], digits[1] << 4 | digits[2], digits[3] << 4 | digits[4]
    for k, two in enumerate(("12", "34", "56")):
        p[13 + k] = int(two[0]) + 1 << 4 | int(two[1]) + 1
    import numpy as np

    p[20:40] = codes.with_odd_parity(np.frombuffer(b"A STATION".ljust(20), np.uint8)).tobytes()
    r = spark.createDataFrame([(p,)], "p binary").select(services.service_information(F.col("p")).alias("s")).first().s
    assert (r.network, r.offset_minutes, str(r.date), r.time, r.status) == (0x1234, -60, "1982-09-06", 12 * 3600 + 34 * 60 + 56, "A STATION")


def extended(kind, typ, text):
    raw = [kind, typ, *text.encode(), *([0] * (len(text) % 2)), 0x0F]
    return [*raw, -sum(raw) % 128]


def test_extended_data(spark):
    one, two = extended(1, 3, "A TITLE"), extended(5, 1, "NETWORK!")
    pairs = list(zip(one[::2], one[1::2], strict=True))
    other = list(zip(two[::2], two[1::2], strict=True))
    stream = pairs[:2] + [(0, 0)] + other + [(2, 3)] + pairs[2:] + [(0x14, 0x2C)] + [(1, 3), (65, 66), (0x0F, 1)]
    df = spark.createDataFrame([("f", k, a, b) for k, (a, b) in enumerate(stream)], "field string, seq long, a int, b int")
    got = {(r["class"], r["type"]): r.data for r in services.extended_data(df, ["field"]).collect()}
    assert got == {(1, 3): "A TITLE", (3, 1): "NETWORK!"}


def test_good_stretches(spark):
    rows = [("f", k, 0x01 if k < 120 else 0x03, 0x01) for k in range(240)]
    got = services.good_stretches(spark.createDataFrame(rows, "field string, seq long, a int, b int"), ["field"])
    assert sorted(r.seq for r in got.collect()) == list(range(120))


def test_files_from_blocks(spark):
    blocks = [("a", 1, b"he", 3), ("a", 2, b"ll", 3), ("a", 2, b"ll", 3), ("a", 2, b"xx", 3), ("a", 3, b"o", 3), ("b", 2, b"z", 2)]
    got = {r.name: (base64.b64encode(r.data).decode(), r.blocks, r.whole) for r in services.assemble(spark.createDataFrame([(n, k, bytearray(d), e) for n, k, d, e in blocks], "name string, number int, data binary, expected int"), "name", "number", "data", "expected").collect()}
    assert got == {"a": (base64.b64encode(b"hello").decode(), 3, True), "b": ("eg==", 1, False)}


def test_file_types(spark):
    data = [(b"PK\x03\x04rest",), (b"MZ\x90\0",), (b"plain text\n",), (b"\x00\x01\x02",), (b"II*\0abc",)]
    got = [r.t for r in spark.createDataFrame([(bytearray(d[0]),) for d in data], "d binary").select(services.file_type(F.col("d")).alias("t")).collect()]
    assert got == ["zip", "exe", "text", None, "tiff"]


def test_on_air(spark):
    slots = spark.createDataFrame([("c", 0, 30, "one"), ("c", 30, 600, "two"), ("d", 10, 5, "three")], "channel string, start long, minutes long, title string")
    clock = spark.createDataFrame([("c", 29), ("c", 30), ("c", 629), ("d", 15)], "channel string, at long")
    got = sorted((r.channel, r.at, r.title, r.following) for r in services.on_air(clock, slots, ["channel"], "at", "start", "minutes").collect())
    assert got == [("c", 29, "one", 30), ("c", 30, "two", None), ("c", 629, "two", None)]


def test_service_dates_of_six_digits(spark, tmp_path):
    rows = [(1, 15000, "1-URGENT"), (2, 50000, "2-HIGH"), (3, 899999, "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: (r.date, r.status) for r in service_queries.D03_service_information(spark, str(tmp_path)).collect()}
    day = datetime.date(1858, 11, 17)
    assert got == {k: (str(day + datetime.timedelta(50000 + c)), s) for k, c, s in rows}
