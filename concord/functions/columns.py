"""Codes as column functions: built-in expressions where SQL can say them, Arrow-batched functions elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions import codes
from concord.plans.work import arrow_udf

# --- built-in expressions over one byte (an int) or over BINARY


def byte_at(data: Column, place: int | Column) -> Column:
    """The byte at a place from 0 as an int; null past the end."""
    place = F.lit(place) if isinstance(place, int) else place
    hexed = F.hex(F.substring(data, place + 1, F.lit(1)))
    return F.when(hexed != "", F.conv(hexed, 16, 10).cast("int"))


def byte_list(data: Column) -> Column:
    """BINARY as an array of ints."""
    # In this charset a byte is the character of its number.
    return F.when(F.length(data) > 0, F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), F.ascii)).otherwise(F.when(F.length(data) == 0, F.array().cast("array<int>")))


def odd_parity(byte: Column) -> Column:
    return F.bit_count(byte) % 2 == 1


def strip_parity(byte: Column, bad: int = 0x20) -> Column:
    """Seven bits of a byte of odd parity, else `bad`."""
    return F.when(odd_parity(byte), byte.bitwiseAND(F.lit(0x7F))).otherwise(F.lit(bad))


@lru_cache
def _literal(name: str) -> tuple[int, ...]:
    table = {"exact": lambda: codes.hamming84_table(False), "mended": lambda: codes.hamming84_table(True), "words": codes.hamming84_words}[name]()
    return tuple(int(x) for x in table)


def hamming84(byte: Column, correct: bool = True) -> Column:
    """0 to 15, or -1: a table of 256 entries in the plan."""
    return F.element_at(F.lit(list(_literal("mended" if correct else "exact"))), byte.cast("int") + 1)


def encode_hamming84(value: Column) -> Column:
    return F.element_at(F.lit(list(_literal("words"))), value.cast("int") + 1)


def packet_address(first: Column, second: Column, correct: bool = True) -> Column:
    """magazine (1 to 8) and row of a packet, from its first two Hamming bytes; null where either can't be read. Not correct: nor where a bit is wrong, as on tape, where a slip of a bit looks like another row."""
    a, b = hamming84(first, correct), hamming84(second, correct)
    low = a.bitwiseAND(F.lit(7))
    return F.when((a >= 0) & (b >= 0), F.struct(F.when(low == 0, 8).otherwise(low).alias("magazine"), (F.shiftright(a, 3) + b * 2).alias("row")))


def reverse_bits(value: Column, width: int = 8) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(value), width, "0")), 2, 10).cast("long")


def bits(word: Column, shift: int, width: int) -> Column:
    """A field of a word, by its lowest bit."""
    return F.shiftright(word, shift).bitwiseAND(F.lit((1 << width) - 1))


def crc32_open(data: Column) -> Column:
    """CRC-32 without the last inversion, from the built-in one."""
    return F.crc32(data).bitwiseXOR(F.lit(0xFFFFFFFF))


def xor_all(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s.bitwiseXOR(x))


def sum_mod128(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: (s + x) % 128)


# --- dates and time codes


def mjd_date(mjd: Column) -> Column:
    """Modified Julian day to date."""
    return F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))


def date_text(date: Column) -> Column:
    """A date as text, years beyond 9999 without Spark's plus sign."""
    return F.ltrim(date.cast("string"), F.lit("+"))


def epoch_minutes(minutes: Column) -> Column:
    """Minutes since 1992-01-01 as a timestamp without zone."""
    return F.expr("TIMESTAMP_NTZ'1992-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def bcd(value: Column) -> Column:
    """Two digits of a byte; null where either isn't one."""
    tens, ones = F.shiftright(value, 4), value.bitwiseAND(F.lit(15))
    return F.when((tens < 10) & (ones < 10), tens * 10 + ones)


def timecode_to_count(h: Column, m: Column, s: Column, f: Column, drop: bool = True) -> Column:
    """The number of a frame at 30 a second; with drop, two numbers are left out of each minute that isn't a tenth."""
    whole = (h * 60 + m).cast("long")
    plain = (whole * 60 + s) * 30 + f
    return plain - (whole - F.floor(whole / 10)) * 2 if drop else plain


def timecode_of(count: Column, drop: bool = True) -> Column:
    """hh:mm:ss:ff of a frame number."""
    n = F.pmod(count.cast("long"), F.lit(24 * 60 * (1798 if drop else 1800) + (24 * 6 * 2 if drop else 0)))
    if drop:
        tens, rest = F.floor(n / 17982), F.pmod(n, F.lit(17982))
        n = n + tens * 18 + F.when(rest >= 2, F.floor((rest - 2) / 1798) * 2).otherwise(0)
    part = lambda d, w: F.lpad(F.pmod(F.floor(n / d), F.lit(w)).cast("string"), 2, "0")
    return F.concat_ws(":", part(108000, 24), part(1800, 60), part(30, 60), part(1, 30))


def clock_line(at: Column, slope: float, base: float) -> Column:
    """Seconds of the day from a fitted line."""
    return F.pmod(F.round(F.lit(base) + slope * at).cast("long"), F.lit(86400))


# --- Arrow-batched functions over BINARY


def by_length(values: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """f over all values of one length at once (rows x bytes); null stays null."""
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    sizes = values.dropna().map(len)
    for size, own in values.dropna().groupby(sizes):
        rows = np.frombuffer(b"".join(map(bytes, own)), np.uint8).reshape(len(own), size)
        out[own.index] = list(f(rows))
    return out


def by_blocks(values: pd.Series, size: int, f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pd.Series:
    """f over the blocks of all values at once (blocks x bytes, the last of a value filled with zeros), which gives new blocks and whether each is good; null stays null, and so is a value with a bad one."""
    count = np.array([0 if v is None else -(-len(v) // size) for v in values], np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    blocks = np.frombuffer(b"".join(bytes(v).ljust(n * size, b"\0") for v, n in zip(values, count.tolist(), strict=True) if v is not None), np.uint8).reshape(-1, size)
    found, good = f(blocks)
    wrong = np.concatenate([[0], np.cumsum(~good)])[at]
    raw, wide = found.tobytes(), found.shape[1]
    spans = zip(values, (at * wide).tolist(), (at[1:] * wide).tolist(), np.diff(wrong).tolist(), strict=False)
    return pd.Series([None if v is None or bad else raw[a:b] for v, a, b, bad in spans], index=values.index, dtype=object)


def crc_column(data: Column, width: int, poly: int, *, init: int = 0, reflected: bool = True) -> Column:
    """Any CRC of BINARY as a long."""

    @arrow_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return by_length(values, lambda rows: codes.crc(rows, width, poly, init=init, reflected=reflected).astype(np.int64)).astype("Int64")

    return run(data)


def encode_bytes(data: Column, kind: str) -> Column:
    """BINARY of bytes under a code, for round trips: parity (a byte each), hamming84 (two), hamming2418 (three for 18 bits)."""

    @arrow_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        if kind == "difference_set":
            return by_blocks(values, 23, lambda rows: (codes.encode_difference_sets(rows), np.ones(len(rows), bool)))
        return by_length(values, lambda rows: [encode(row, kind) for row in rows])

    return run(data)


def decode_bytes(data: Column, size: Column, kind: str) -> Column:
    """The bytes again: BINARY of `size` bytes, null where any byte can't be read."""

    @arrow_udf("binary")
    def run(values: pd.Series, sizes: pd.Series) -> pd.Series:
        if kind == "difference_set":
            return pd.Series([None if v is None else v[: int(n)] for v, n in zip(by_blocks(values, 34, codes.decode_difference_sets), sizes, strict=True)], dtype=object)
        return pd.Series([None if v is None else decode(np.frombuffer(v, np.uint8), int(n), kind) for v, n in zip(values, sizes, strict=True)])

    return run(data, size)


def packed(data: np.ndarray, width: int) -> np.ndarray:
    """Bytes as numbers of `width` bits, lowest first, the last filled with zeros."""
    stream = np.unpackbits(data, bitorder="little")
    stream = np.concatenate([stream, np.zeros(-len(stream) % width, np.uint8)]).reshape(-1, width)
    return (stream.astype(np.int64) << np.arange(width)).sum(axis=1)


def unpacked(values: np.ndarray, width: int, size: int) -> np.ndarray:
    stream = (values[:, None] >> np.arange(width) & 1).astype(np.uint8).ravel()
    return np.packbits(stream[: 8 * size], bitorder="little")


def encode(data: np.ndarray, kind: str) -> bytes:
    if kind == "parity":  # seven bits a byte
        return codes.with_odd_parity(packed(data, 7).astype(np.uint8)).tobytes()
    if kind == "hamming84":
        return codes.encode_hamming84(packed(data, 4)).tobytes()
    if kind == "hamming2418":
        words = codes.encode_hamming2418(packed(data, 18))
        return (words[:, None] >> np.array([0, 8, 16]) & 255).astype(np.uint8).tobytes()
    if kind == "hamming74":
        return codes.encode_hamming74(packed(data, 4)).astype(np.uint8).tobytes()
    if kind == "bch":
        return b"".join(codes.encode_bch(int(v)).to_bytes(8, "little") for v in packed(data, 51))
    if kind == "product":
        block = np.zeros((14, 26), np.uint8)
        whole = np.concatenate([data, np.zeros(-len(data) % block.size, np.uint8)]).reshape(-1, 14, 26)
        return b"".join(codes.encode_product(b).tobytes() for b in whole)
    raise ValueError(kind)


def decode(data: np.ndarray, size: int, kind: str) -> bytes | None:
    if kind == "parity":
        return unpacked((data & 0x7F).astype(np.int64), 7, size).tobytes() if codes.odd_parity(data).all() else None
    if kind == "hamming84":
        values = codes.hamming84(data).astype(np.int64)
        return unpacked(values, 4, size).tobytes() if (values >= 0).all() else None
    if kind == "hamming2418":
        words = (data.reshape(-1, 3).astype(np.int64) << np.array([0, 8, 16])).sum(axis=1)
        values = codes.hamming2418(words)
        return unpacked(values, 18, size).tobytes() if (values >= 0).all() else None
    if kind == "hamming74":
        return unpacked(codes.hamming74(data), 4, size).tobytes()
    if kind == "bch":
        values = np.array([codes.decode_bch(int.from_bytes(data[k : k + 8].tobytes(), "little")) for k in range(0, len(data), 8)])
        return unpacked(values, 51, size).tobytes() if (values >= 0).all() else None
    if kind == "product":
        out = [codes.decode_product(b, np.zeros(b.shape, bool)) for b in data.reshape(-1, 16, 28)]
        return b"".join(d.tobytes() for d, _ in out)[:size] if all(g.all() for _, g in out) else None
    raise ValueError(kind)


def damage(data: Column, seed: Column, kind: str) -> Column:
    """What the code can mend, put into its words at places that `seed` decides: one wrong bit a Hamming word, two a BCH word, eight a difference-set word, two wrong bytes a product block."""

    @arrow_udf("binary")
    def run(values: pd.Series, seeds: pd.Series) -> pd.Series:
        out = []
        for v, s in zip(values, seeds, strict=True):
            if v is None:
                out.append(None)
                continue
            raw, rng = np.frombuffer(v, np.uint8).copy(), np.random.default_rng(abs(int(s)))
            unit, bits_of, wrong = {"hamming84": (1, 8, 1), "hamming2418": (3, 24, 1), "hamming74": (1, 7, 1), "bch": (8, 63, 2), "difference_set": (34, 272, 8), "product": (448, 448, 2)}[kind]
            words = np.arange(0, len(raw), unit)
            places = rng.random((len(words), bits_of)).argpartition(wrong, axis=1)[:, :wrong]
            if kind == "product":
                raw[(words[:, None] + places).ravel()] ^= 0x5A
            else:
                np.bitwise_xor.at(raw, words[:, None] + places // 8, (1 << places % 8).astype(np.uint8))
            out.append(raw.tobytes())
        return pd.Series(out)

    return run(data, seed)


def tv_line(stored: Column, lines: int, first: int, pal: bool = True, starts: tuple[int, int] = (0, 0)) -> Column:
    """line (of its field) and field of a stored line, from 0, of frames with so many lines; first: the TV line of the first one, starts: those of each field's first line where they are known."""
    half, later, total = lines // 2, (313 if pal else 263), (625 if pal else 525)

    def of(field: int) -> Column:
        place = stored % half
        return (starts[field] - 1 + place) % total + 1 if starts[field] > 0 else first + place + field * later

    tv = F.when(stored < half, of(0)).otherwise(of(1))
    return F.struct(F.when(tv > later, tv - later).otherwise(tv).cast("int").alias("line"), F.when(tv > later, 2).otherwise(1).alias("field"))


def recording_time(seconds: Column) -> Column:
    """hh:mm:ss.s of a time from the beginning of a recording; what is before it is 0."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    return F.format_string("%02d:%02d:%04.1f", F.floor(s / 3600), F.floor(s / 60) % 60, F.bround(s % 60, 1))
