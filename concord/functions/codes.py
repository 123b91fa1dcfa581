"""Error-detecting and error-correcting codes over bytes and bits, as NumPy functions over many rows at once.

A code word that can't be corrected decodes to -1 (or to flagged bytes); nothing that is called good by a detecting code is
changed. Tables are made from the rule of the code.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)

# --- parity and Hamming codes


def odd_parity(data: np.ndarray) -> np.ndarray:
    """Which bytes have an odd number of ones."""
    return ONES[data] % 2 == 1


def with_odd_parity(data: np.ndarray) -> np.ndarray:
    """Seven-bit bytes with the eighth bit set so that the ones are odd."""
    low = data & 0x7F
    return low | np.where(ONES[low] % 2 == 0, 0x80, 0).astype(np.uint8)


def hamming84_words() -> np.ndarray:
    """The 16 code words, first bit lowest: P1 D1 P2 D2 P3 D3 P4 D4, all checks odd."""
    out = np.zeros(16, np.uint8)
    for v in range(16):
        d1, d2, d3, d4 = (v >> k & 1 for k in range(4))
        p1, p2, p3 = 1 ^ d1 ^ d3 ^ d4, 1 ^ d1 ^ d2 ^ d4, 1 ^ d1 ^ d2 ^ d3
        bits = [p1, d1, p2, d2, p3, d3, 0, d4]
        bits[6] = 1 ^ (sum(bits) & 1)
        out[v] = sum(b << k for k, b in enumerate(bits))
    return out


@lru_cache
def hamming84_table(correct: bool = True) -> np.ndarray:
    """What each byte decodes to: 0 to 15, or -1; with correct, one wrong bit is mended."""
    out = np.full(256, -1, np.int16)
    for v, w in enumerate(hamming84_words().tolist()):
        if correct:
            out[[w ^ (1 << k) for k in range(8)]] = v
        out[w] = v
    return out


def hamming84(data: np.ndarray, correct: bool = True) -> np.ndarray:
    return hamming84_table(correct)[data]


def encode_hamming84(values: np.ndarray) -> np.ndarray:
    return hamming84_words()[values]


#: Places 1 to 24 of a Hamming 24/18 word that hold data; the powers of two and the last hold checks.
DATA_24 = [k for k in range(1, 24) if k & (k - 1)]


def encode_hamming2418(values: np.ndarray) -> np.ndarray:
    """18 bits to 24, first bit lowest: odd checks at places 1, 2, 4, 8, 16, and place 24 over all."""
    values = np.asarray(values, np.int64)
    word, check = np.zeros_like(values), np.zeros_like(values)
    for k, place in enumerate(DATA_24):
        bit = values >> k & 1
        word |= bit << (place - 1)
        check ^= bit * place
    check ^= 0x1F
    for k in range(5):
        word |= (check >> k & 1) << ((1 << k) - 1)
    ones = sum(word >> k & 1 for k in range(23))
    return word | ((ones + 1) % 2 << 23)


def hamming2418(words: np.ndarray) -> np.ndarray:
    """18 bits of each 24-bit word, or -1 with two wrong bits."""
    words = np.asarray(words, np.int64)
    check = np.full(words.shape, 0x1F)
    ones = np.zeros(words.shape, np.int64)
    for place in range(1, 25):
        bit = words >> (place - 1) & 1
        ones += bit
        if place < 24:
            check = check ^ bit * place
    whole = ones % 2 == 1
    place = np.where(~whole & (check > 0), check, 0)  # one wrong bit, at this place; a wrong last bit leaves the checks right
    fixed = np.where(place > 0, words ^ (1 << np.maximum(place - 1, 0)), words)
    out = np.zeros_like(words)
    for k, p in enumerate(DATA_24):
        out |= (fixed >> (p - 1) & 1) << k
    return np.where((whole & (check > 0)) | (place > 23), -1, out)


def encode_hamming74(values: np.ndarray) -> np.ndarray:
    """4 bits to 7 at places 7 6 5 4 3 2 1, even checks at 4, 2 and 1."""
    values = np.asarray(values, np.int64)
    word, check = np.zeros_like(values), np.zeros_like(values)
    for k, place in enumerate((3, 5, 6, 7)):
        bit = values >> k & 1
        word |= bit << (place - 1)
        check ^= bit * place
    for k in range(3):
        word |= (check >> k & 1) << ((1 << k) - 1)
    return word


def hamming74(words: np.ndarray) -> np.ndarray:
    """4 bits of each 7-bit word; one wrong bit is mended."""
    words = np.asarray(words, np.int64)
    check = np.zeros_like(words)
    for place in range(1, 8):
        check ^= (words >> (place - 1) & 1) * place
    fixed = np.where(check > 0, words ^ (1 << np.maximum(check - 1, 0)), words)
    return (fixed >> 2 & 1) | (fixed >> 4 & 1) << 1 | (fixed >> 5 & 1) << 2 | (fixed >> 6 & 1) << 3


# --- checks


@lru_cache
def crc_table(width: int, poly: int, reflected: bool) -> np.ndarray:
    """The remainder of each byte."""
    mask, out = (1 << width) - 1, []
    flipped = int(f"{poly:0{width}b}"[::-1], 2)
    for b in range(256):
        r = b if reflected else b << (width - 8)
        for _ in range(8):
            if reflected:
                r = (r >> 1) ^ (flipped if r & 1 else 0)
            else:
                r = ((r << 1) ^ (poly if r >> (width - 1) & 1 else 0)) & mask
        out.append(r)
    return np.array(out, np.uint64)


def crc(rows: np.ndarray, width: int, poly: int, *, init: int = 0, reflected: bool = True, out: int = 0) -> np.ndarray:
    """The CRC of each row of bytes (rows x bytes)."""
    table, mask = crc_table(width, poly, reflected), np.uint64((1 << width) - 1)
    r = np.full(len(rows), init, np.uint64)
    for column in rows.T:
        if reflected:
            r = (r >> np.uint64(8)) ^ table[((r ^ column) & np.uint64(255)).astype(np.int64)]
        else:
            r = ((r << np.uint64(8)) & mask) ^ table[((r >> np.uint64(width - 8)) ^ column).astype(np.int64) & 255]
    return r ^ np.uint64(out)


def crc32_open(rows: np.ndarray) -> np.ndarray:
    """CRC-32 without the last inversion."""
    return crc(rows, 32, 0x04C11DB7, init=0xFFFFFFFF)


def crc16_arc(rows: np.ndarray) -> np.ndarray:
    return crc(rows, 16, 0x8005)


def crc16_kermit(rows: np.ndarray) -> np.ndarray:
    return crc(rows, 16, 0x1021)


def repair_by_syndrome(rows: np.ndarray, right: np.ndarray, width: int, poly: int, *, init: int = 0, bits: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows, flips): each row whose CRC isn't `right` mended by the only one (or two) flipped bits that explain it; flips is -1 where none does."""
    n = rows.shape[1]
    unit = np.zeros((8 * n, n), np.uint8)
    unit[np.arange(8 * n), np.arange(8 * n) // 8] = 1 << np.arange(8 * n) % 8
    zero = crc(np.zeros((1, n), np.uint8), width, poly, init=init)[0]
    effect = crc(unit, width, poly, init=init) ^ zero
    known: dict[int, tuple[int, ...] | None] = {}
    for size in range(1, bits + 1):
        for some in combinations(range(8 * n), size):
            s = int(np.bitwise_xor.reduce(effect[list(some)]))
            known[s] = None if s in known and (known[s] is None or len(known[s]) == size) else known.get(s, some)
    rows, flips = rows.copy(), np.zeros(len(rows), np.int64)
    wrong = crc(rows, width, poly, init=init) ^ right.astype(np.uint64)
    for k in np.flatnonzero(wrong):
        some = known.get(int(wrong[k]))
        flips[k] = len(some) if some else -1
        for b in some or ():
            rows[k, b // 8] ^= 1 << b % 8
    return rows, flips


def chase(row: np.ndarray, confidence: np.ndarray, right: int, width: int, poly: int, *, init: int = 0, weak: int = 16, most: int = 3) -> tuple[np.ndarray, int]:
    """(row, flips): the fewest flips among the `weak` least sure bits that make the CRC right; -1 if up to `most` can't."""
    if int(crc(row[None], width, poly, init=init)[0]) == right:
        return row, 0
    order = np.argsort(confidence, kind="stable")[:weak]
    for size in range(1, most + 1):
        some = list(combinations(order.tolist(), size))
        tried = np.repeat(row[None], len(some), 0)
        for k, flips in enumerate(some):
            for b in flips:
                tried[k, b // 8] ^= 1 << b % 8
        good = np.flatnonzero(crc(tried, width, poly, init=init) == right)
        if len(good):
            return tried[good[0]], size
    return row, -1


def checksum_mod128(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.int64).sum(axis=1) % 128


def xor_lrc(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(rows, axis=1)


def locate_by_parity(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, place): rows whose bytes XOR to zero when whole; a single byte of wrong parity is mended by the XOR of all. place: -1 whole, -2 beyond repair."""
    bad, over = ~odd_parity(rows), xor_lrc(rows)
    place = np.where((over == 0) & ~bad.any(axis=1), -1, np.where(bad.sum(axis=1) == 1, bad.argmax(axis=1), -2))
    out = rows.copy()
    at = np.flatnonzero(place >= 0)
    out[at, place[at]] ^= over[at]
    return out, place


def vitc_crc(bits: np.ndarray) -> np.ndarray:
    """The check x^8 + 1 over 82 bits: what the last eight should be."""
    out = np.zeros((len(bits), 8), np.uint8)
    for k in range(bits.shape[1]):
        out[:, k % 8] ^= bits[:, k]
    return np.roll(out, -(bits.shape[1] % 8), axis=1)


# --- cyclic codes


def poly_mod(value: int, generator: int) -> int:
    size = generator.bit_length()
    while value.bit_length() >= size:
        value ^= generator << (value.bit_length() - size)
    return value


def poly_mul(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return out


#: x^6 + x + 1 and the minimal polynomial of the cube of its root: the generator of BCH(63,51).
BCH = poly_mul(0b1000011, 0b1010111)


def encode_bch(data: int) -> int:
    """51 bits to 63."""
    return data << 12 | poly_mod(data << 12, BCH)


@lru_cache
def bch_errors() -> dict[int, int]:
    """The pattern of one or two wrong bits behind each remainder."""
    out = {}
    for a in range(63):
        out[poly_mod(1 << a, BCH)] = 1 << a
        for b in range(a):
            out[poly_mod(1 << a ^ 1 << b, BCH)] = 1 << a ^ 1 << b
    return out


def decode_bch(word: int) -> int:
    """The 51 bits of a word with up to two wrong ones, else -1."""
    left = poly_mod(word, BCH)
    if left:
        if left not in bch_errors():
            return -1
        word ^= bch_errors()[left]
    return word >> 12


#: The generator of the shortened difference-set code (272,190), by its exponents, and the perfect difference set of 17 modulo 273.
DIFFERENCE_SET_GENERATOR = sum(1 << k for k in (82, 77, 76, 71, 67, 66, 56, 52, 48, 40, 36, 34, 24, 22, 18, 10, 4, 0))
DIFFERENCE_SET = (0, 18, 24, 46, 50, 67, 103, 112, 115, 126, 128, 159, 166, 167, 186, 196, 201)


def encode_difference_set(data: int) -> int:
    """190 bits to 272."""
    return data << 82 | poly_mod(data << 82, DIFFERENCE_SET_GENERATOR)


@lru_cache
def difference_checks() -> np.ndarray:
    """273 x 17 x 17 places: for each bit the 17 checks that have it, and only it, in common."""
    d = np.array(DIFFERENCE_SET)
    for sign in (1, -1):
        rows = (np.arange(273)[:, None, None] + sign * (d[None, None, :] - d[None, :, None])) % 273
        word = encode_difference_set((1 << 190) - 12345)
        bits = np.array([word >> k & 1 for k in range(272)] + [0], np.uint8)
        if not (bits[rows].sum(axis=2) % 2).any():
            return rows
    raise AssertionError("the difference set doesn't belong to the generator")


def decode_difference_set(words: list[int], rounds: int = 12, least: int = 9) -> list[int]:
    """The 190 bits of each word by majority logic (up to eight wrong bits), else -1."""
    bits = np.array([[w >> k & 1 for k in range(272)] + [0] for w in words], np.uint8)
    checks = difference_checks()
    for _ in range(rounds):
        votes = (bits[:, checks].sum(axis=3) % 2).sum(axis=2)
        top = votes.max(axis=1, keepdims=True)
        flip = (votes >= least) & (votes == top)
        flip[:, 272] = False
        if not flip.any():
            break
        bits ^= flip.astype(np.uint8)
    out = []
    for row in bits:
        word = sum(int(b) << k for k, b in enumerate(row[:272]))
        out.append(word >> 82 if poly_mod(word, DIFFERENCE_SET_GENERATOR) == 0 else -1)
    return out


@lru_cache
def difference_set_tables() -> np.ndarray:
    """23 x 256 code words of five 64-bit numbers: those of each byte at each place of a block of 23."""
    of_bit = [np.frombuffer(encode_difference_set(1 << k).to_bytes(40, "little"), np.uint64) for k in range(184)]
    tables = np.zeros((23, 256, 5), np.uint64)
    for place in range(23):
        for k in range(8):
            tables[place, np.arange(256) >> k & 1 == 1] ^= of_bit[8 * place + k]
    return tables


def encode_difference_sets(blocks: np.ndarray) -> np.ndarray:
    """Code words of 34 bytes, lowest bits first, of blocks of 23 bytes (184 of a word's 190 bits)."""
    tables, words = difference_set_tables(), np.zeros((len(blocks), 5), np.uint64)
    for place in range(23):
        words ^= tables[place, blocks[:, place]]
    return words.view(np.uint8).reshape(-1, 40)[:, :34]


def decode_difference_sets(words: np.ndarray, rounds: int = 12, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of 23 bytes, whether each is a code word in the end) of words of 34 bytes, as decode_difference_set has them with a quorum of 9.

    A bit's votes are the checks that hold it, and a check is one of 273 that are the others turned, so each is computed once; words are
    worked through side by side, 64 in a number, with a plane for each of their bits.
    """
    out, good = np.zeros((len(words), 23), np.uint8), np.zeros(len(words), bool)
    # Which way the checks are turned, from what difference_checks found.
    places = DIFFERENCE_SET if difference_checks()[0, 0, 1] == DIFFERENCE_SET[1] else tuple(-d % 273 for d in DIFFERENCE_SET)
    twice = lambda planes: np.concatenate([planes, planes])
    for first in range(0, len(words), chunk):
        some = words[first : first + chunk]
        n = -len(some) % 64 + len(some)
        bits = np.zeros((n, 272), np.uint8)
        bits[: len(some)] = np.unpackbits(some, axis=1, bitorder="little")
        planes = np.zeros((273, n // 64), np.uint64)
        planes[:272] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
        for turn in range(rounds + 1):
            doubled = twice(planes)
            checks = np.bitwise_xor.reduce([doubled[d : d + 273] for d in places])
            if turn == rounds or not checks.any():
                break
            doubled = twice(checks)
            count = _counts([doubled[273 - d : 546 - d] for d in places])
            flip = count[4] | (count[3] & (count[0] | count[1] | count[2]))  # nine or more of 17
            best = np.full_like(planes, np.uint64(0xFFFFFFFFFFFFFFFF))
            for c in reversed(count):  # those with the most votes of their word
                best &= c | ~np.bitwise_or.reduce(best & c, axis=0)
            flip &= best
            flip[272] = 0
            if not flip.any():
                break
            planes ^= flip
        bad = np.unpackbits(np.bitwise_or.reduce(checks, axis=0).view(np.uint8), bitorder="little")
        good[first : first + chunk] = bad[: len(some)] == 0
        bits = np.unpackbits(planes[82:266].copy().view(np.uint8), axis=1, bitorder="little")
        out[first : first + chunk] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")[: len(some)]
    return out, good


def _counts(planes: list[np.ndarray]) -> list[np.ndarray]:
    """How many of 17 planes have each bit, as five planes, lowest first."""
    count = [np.zeros_like(planes[0]) for _ in range(5)]
    for k in range(0, 16, 2):  # two at once by a full adder
        a, b, c = count[0], planes[k], planes[k + 1]
        half = a ^ b
        carry = (a & b) | (half & c)
        count[0] = half ^ c
        for i in range(1, 5):
            count[i], carry = count[i] ^ carry, count[i] & carry
    carry = planes[16]
    for i in range(5):
        count[i], carry = count[i] ^ carry, count[i] & carry
    return count


# --- a product code over GF(256)

GF = 0x11D


@lru_cache
def gf_tables() -> tuple[np.ndarray, np.ndarray]:
    power, log = np.zeros(510, np.int64), np.zeros(256, np.int64)
    x = 1
    for k in range(255):
        power[k] = power[k + 255] = x
        log[x] = k
        x <<= 1
        if x & 256:
            x ^= GF
    return power, log


def gf_mul(a, b) -> np.ndarray:
    power, log = gf_tables()
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, power[log[a] + log[b]])


def line_syndromes(line: np.ndarray) -> tuple[int, int]:
    """The sums of all bytes, times a^k and times a^3k, of a line of bytes with its two check bytes last."""
    power, _ = gf_tables()
    k = np.arange(len(line))
    return int(np.bitwise_xor.reduce(gf_mul(line, power[k % 255]))), int(np.bitwise_xor.reduce(gf_mul(line, power[3 * k % 255])))


def fill_two(line: np.ndarray, i: int, j: int) -> bool:
    """Set the bytes at i and j so that both sums are zero; False where they can't be told apart."""
    power, log = gf_tables()
    line[i] = line[j] = 0
    s0, s1 = line_syndromes(line)
    a, b, c, d = power[i % 255], power[j % 255], power[3 * i % 255], power[3 * j % 255]
    det = int(gf_mul(a, d) ^ gf_mul(b, c))
    if det == 0:
        return False
    over = power[(255 - log[det]) % 255]
    line[i], line[j] = gf_mul(gf_mul(s0, d) ^ gf_mul(s1, b), over), gf_mul(gf_mul(s1, a) ^ gf_mul(s0, c), over)
    return True


def mend_line(line: np.ndarray, lost: np.ndarray) -> bool:
    """Mend up to two lost bytes, or one wrong byte where none is lost, in place; True if the line is whole afterwards."""
    power, log = gf_tables()
    gone = np.flatnonzero(lost)
    if len(gone) > 2:
        return False
    if len(gone):
        other = int(gone[1]) if len(gone) == 2 else (int(gone[0]) + 1) % len(line)
        held = line.copy()
        if not fill_two(line, int(gone[0]), other) or (len(gone) == 1 and line[other] != held[other]):
            line[:] = held
            return False
        lost[:] = False
        return True
    s0, s1 = line_syndromes(line)
    if s0 == 0 and s1 == 0:
        return True
    if s0 and s1:
        # One wrong byte e at k: s0 = e a^k and s1 = e a^3k.
        two = (log[s1] - log[s0]) % 255
        k = two // 2 if two % 2 == 0 else (two + 255) // 2
        if k < len(line):
            line[k] ^= int(power[(log[s0] - k) % 255])
            return True
    return False


def all_syndromes(lines: np.ndarray) -> np.ndarray:
    """Both sums of every line (lines x bytes)."""
    power, _ = gf_tables()
    k = np.arange(lines.shape[1])
    return np.stack([np.bitwise_xor.reduce(gf_mul(lines, power[f * k % 255][None]), axis=1) for f in (1, 3)], axis=1)


def with_checks(lines: np.ndarray) -> np.ndarray:
    """Lines with their last two bytes set so that both sums are zero."""
    power, log = gf_tables()
    out = lines.copy()
    i, j = out.shape[1] - 2, out.shape[1] - 1
    out[:, i:] = 0
    s0, s1 = all_syndromes(out).T
    a, b, c, d = (int(power[f * k % 255]) for f, k in ((1, i), (1, j), (3, i), (3, j)))
    over = power[(255 - log[int(gf_mul(a, d) ^ gf_mul(b, c))]) % 255]
    out[:, i], out[:, j] = gf_mul(gf_mul(s0, d) ^ gf_mul(s1, b), over), gf_mul(gf_mul(s1, a) ^ gf_mul(s0, c), over)
    return out


def encode_product(data: np.ndarray) -> np.ndarray:
    """Rows x columns of bytes with two check bytes to every row and two check rows."""
    out = np.zeros((data.shape[0] + 2, data.shape[1] + 2), np.uint8)
    out[:-2, :-2] = data
    out[:-2] = with_checks(out[:-2])
    out[:] = with_checks(out.T.copy()).T
    return out


def decode_product(block: np.ndarray, lost: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(data, good): rows and columns mended in turn; a row is good if both its sums are zero and nothing in it is lost."""
    block, lost = block.copy(), lost.copy()
    for _ in range(rounds):
        before = block.copy(), lost.copy()
        for lines, gone in ((block, lost), (block.T, lost.T)):
            for k in np.flatnonzero(all_syndromes(lines).any(axis=1) | gone.any(axis=1)):
                mend_line(lines[k], gone[k])
        if np.array_equal(before[0], block) and np.array_equal(before[1], lost):
            break
    good = ~all_syndromes(block[:-2]).any(axis=1) & ~lost[:-2].any(axis=1)
    whole = not all_syndromes(block.T).any()
    return block[:-2, :-2], good & (whole | good.all())
