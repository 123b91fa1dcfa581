"""Codes: published check values, round trips, and seeded damage: what is called good must equal the truth."""

import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.functions import codes
from concord.functions import columns as K

CHECK = np.frombuffer(b"123456789", np.uint8)[None]


def test_published_values():
    assert codes.hamming84_words().tolist() == [0x15, 0x02, 0x49, 0x5E, 0x64, 0x73, 0x38, 0x2F, 0xD0, 0xC7, 0x8C, 0x9B, 0xA1, 0xB6, 0xFD, 0xEA]
    assert codes.crc16_arc(CHECK)[0] == 0xBB3D and codes.crc16_kermit(CHECK)[0] == 0x2189
    assert codes.crc32_open(CHECK)[0] ^ 0xFFFFFFFF == 0xCBF43926
    assert codes.crc(CHECK, 16, 0x1021, init=0xFFFF, reflected=False)[0] == 0x29B1


def test_hamming84_mends_one_and_sees_two():
    words = codes.hamming84_words()
    for v, w in enumerate(words.tolist()):
        assert all(codes.hamming84(np.array([w ^ 1 << k], np.uint8))[0] == v for k in range(8))
        assert all(codes.hamming84(np.array([w ^ 1 << k ^ 1 << j], np.uint8))[0] == -1 for k in range(8) for j in range(k))
        assert codes.hamming84(np.array([w ^ 1], np.uint8), correct=False)[0] == -1


def test_hamming2418():
    v = np.arange(0, 1 << 18, 7)
    w = codes.encode_hamming2418(v)
    assert all((codes.hamming2418(w ^ (1 << k)) == v).all() for k in range(24))
    assert all((codes.hamming2418(w ^ (1 << k) ^ (1 << j)) == -1).all() for k in range(24) for j in range(k))


def test_hamming74():
    v = np.arange(16)
    assert all((codes.hamming74(codes.encode_hamming74(v) ^ (1 << k)) == v).all() for k in range(7))


@given(st.integers(0, 2**51 - 1), st.sets(st.integers(0, 62), max_size=2))
@settings(max_examples=60, deadline=None)
def test_bch(value, wrong):
    assert codes.decode_bch(codes.encode_bch(value) ^ sum(1 << b for b in wrong)) == value


@given(st.integers(0, 2**190 - 1), st.sets(st.integers(0, 271), max_size=8))
@settings(max_examples=30, deadline=None)
def test_difference_set(value, wrong):
    assert codes.decode_difference_set([codes.encode_difference_set(value) ^ sum(1 << b for b in wrong)]) == [value]


def test_product_code_never_calls_a_wrong_row_good():
    rng = np.random.default_rng(1234)
    usable = 0
    for _ in range(150):
        data = rng.integers(0, 256, (14, 26)).astype(np.uint8)
        sent, lost = codes.encode_product(data), np.zeros((16, 28), bool)
        for row in range(16):
            u = rng.random()
            if u < 0.03:
                sent[row], lost[row] = 0, True
            elif u < 0.16:
                for c in rng.choice(28, 1 if u < 0.13 else 2, replace=False):
                    sent[row, c] ^= rng.integers(1, 256)
        got, good = codes.decode_product(sent, lost)
        assert (got[good] == data[good]).all()
        usable += bool(good.all())
    assert usable >= 0.8 * 150


def test_crc_repair():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 256, (40, 8)).astype(np.uint8)
    right = codes.crc(rows, 32, 0x04C11DB7)
    bent = rows.copy()
    for k in range(1, 40):
        for b in rng.choice(64, 1 + k % 2, replace=False):
            bent[k, b // 8] ^= 1 << b % 8
    got, flips = codes.repair_by_syndrome(bent, right, 32, 0x04C11DB7, bits=2)
    assert np.array_equal(got, rows) and flips.tolist() == [0, *(1 + k % 2 for k in range(1, 40))]
    far = rows[:1] ^ np.uint8(0x55)
    assert codes.repair_by_syndrome(far, right[:1], 32, 0x04C11DB7, bits=2)[1][0] == -1


def test_chase_flips_weak_bits():
    row = np.frombuffer(b"some packet", np.uint8).copy()
    right = int(codes.crc(row[None], 16, 0x1021)[0])
    sure = np.ones(88)
    sure[[5, 17, 40, 60, 61]] = 0.1
    bent = row.copy()
    for b in (5, 40, 61):
        bent[b // 8] ^= 1 << b % 8
    got, flips = codes.chase(bent, sure, right, 16, 0x1021, weak=5)
    assert flips == 3 and np.array_equal(got, row)


def test_parity_locates_a_byte():
    data = codes.with_odd_parity(np.arange(30, dtype=np.uint8).reshape(3, 10))
    last = codes.xor_lrc(data)
    rows = np.concatenate([data, last[:, None]], axis=1)
    odd = codes.odd_parity(rows).all(axis=1)
    rows = rows[odd]
    bent = rows.copy()
    bent[:, 4] ^= 0x10
    got, place = codes.locate_by_parity(bent)
    assert np.array_equal(got, rows) and (place == 4).all()
    bent[:, 6] ^= 0x01
    assert (codes.locate_by_parity(bent)[1] == -2).all()


@pytest.mark.parametrize("kind", ["parity", "hamming84", "hamming2418", "hamming74", "bch", "difference_set", "product"])
def test_round_trips_with_damage(spark, kind):
    rng = random.Random(7)
    rows = [(i, bytearray(rng.randbytes(rng.randint(1, 90)))) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, data binary").withColumn("sent", K.encode_bytes(F.col("data"), kind))
    if kind != "parity":
        df = df.withColumn("sent", K.damage(F.col("sent"), F.col("k"), kind))
    assert df.filter(~K.decode_bytes(F.col("sent"), F.length("data"), kind).eqNullSafe(F.col("data"))).count() == 0


def test_column_functions(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "d binary")
    r = df.select(K.crc_column(F.col("d"), 16, 0x8005).alias("arc"), K.crc32_open(F.col("d")).alias("open"), K.byte_list(F.col("d")).alias("l"), K.byte_at(F.col("d"), 3).alias("b")).collect()
    assert r[0].arc == 0xBB3D and r[0].open == zlib.crc32(b"123456789") ^ 0xFFFFFFFF and r[0].l == list(b"123456789") and r[0].b == ord("4")
    assert r[1].l == [] and r[1].b is None and r[2].arc is None
    one = spark.range(1)
    v = one.select(K.mjd_date(F.lit(45218)).cast("string").alias("d"), K.bcd(F.lit(0x59)).alias("b"), K.bcd(F.lit(0x5A)).alias("n"), K.reverse_bits(F.lit(0b10110000)).alias("r"), K.epoch_minutes(F.lit(1441)).cast("string").alias("e")).first()
    assert tuple(v) == ("1982-09-06", 59, None, 0b00001101, "1992-01-02 00:01:00")


def test_drop_frame_time_codes(spark):
    cases = [(0, 0, 59, 29, 1799), (0, 1, 0, 2, 1800), (0, 10, 0, 0, 17982), (1, 0, 0, 0, 107892), (23, 59, 59, 29, 2589407)]
    df = spark.createDataFrame(cases, "h int, m int, s int, f int, n long")
    got = df.select("n", K.timecode_to_count(*map(F.col, "hmsf")).alias("c"), K.timecode_of(F.col("n")).alias("t"), F.format_string("%02d:%02d:%02d:%02d", "h", "m", "s", "f").alias("w")).collect()
    assert all(r.c == r.n and r.t == r.w for r in got)


def test_dates_beyond_the_year_9999(spark):
    v = spark.range(1).select(K.date_text(K.mjd_date(F.lit(2973483))).alias("a"), K.date_text(K.mjd_date(F.lit(2973484))).alias("b"), K.date_text(K.mjd_date(F.lit(5999999))).alias("c")).first()
    assert tuple(v) == ("9999-12-31", "10000-01-01", "18286-04-26")


def test_difference_sets_of_many_words():
    """As the plain decoder has them, with up to twice as many wrong bits as it mends for sure, and in time that it doesn't take."""
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (300, 23)).astype(np.uint8)
    sent = codes.encode_difference_sets(blocks).copy()
    assert [int.from_bytes(w.tobytes(), "little") for w in sent] == [codes.encode_difference_set(int.from_bytes(b.tobytes(), "little")) for b in blocks]
    for k, word in enumerate(sent):
        for bit in rng.choice(272, k % 17, replace=False):
            word[bit // 8] ^= 1 << bit % 8
    got, good = codes.decode_difference_sets(sent, chunk=128)
    plain = codes.decode_difference_set([int.from_bytes(w.tobytes(), "little") for w in sent])
    assert good.tolist() == [v >= 0 for v in plain] and 0 < good.sum() < 300
    assert all(g.tobytes() == v.to_bytes(24, "little")[:23] for g, v, ok in zip(got, plain, good, strict=True) if ok)
    many = np.tile(blocks, (200, 1))
    began = time.process_time()
    got, good = codes.decode_difference_sets(codes.encode_difference_sets(many))
    assert good.all() and np.array_equal(got, many) and time.process_time() - began < 20  # the plain one takes minutes
