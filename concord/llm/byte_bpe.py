"""Token counts and ids of a byte-level BPE vocabulary, with the whole-token shortcut.

The library splits a text into pre-tokens and merges each alone, so a text's tokens are those of its pre-tokens. Offline, every
vocabulary string is encoded alone: those that come back as one id are proven whole tokens, and a pre-token that equals one of
them counts directly. The rest are merged by the library's model, each distinct one once for a worker's bounded memory of them.

Texts of ASCII, of the letters of Latin-1 and Latin Extended-A and of their usual signs are split on their bytes with NumPy, all
texts of a batch at once; others by the pattern itself. Pre-tokens are known by 64-bit hashes.

Defined results: a null text is empty and has no tokens; strings of added tokens inside texts are those tokens, as the library
takes them by default; repeated rows give repeated rows; texts that the pattern splits go in stretches that end before a lone
space, where no pre-token continues; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded, pieces, text_buffer
from .piece_table import PieceTable, sums
from .words import hash_words

#: How a byte-level pre-tokeniser splits, and the bytes it writes as themselves.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LONE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
#: Distinct pre-tokens that a worker remembers; characters of a text that the pattern splits at once.
MEMORY, STRETCH = 700_000, 2_000_000

#: The character that stands for each byte.
STANDS = np.zeros(256, "<u2")
STANDS[PLAIN] = PLAIN
STANDS[[b for b in range(256) if b not in PLAIN]] = 256 + np.arange(256 - len(PLAIN))

#: Kinds of bytes: letter, digit, white space, other; and bytes of which a text needs the pattern.
LETTER, DIGIT, WHITE, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[0x20, *range(0x09, 0x0E)]] = WHITE
KIND[0x80:0xC0] = LETTER  # the second byte of a letter, unless it is seen to be otherwise
KIND[[0xC3, 0xC4, 0xC5]] = LETTER
HARD = np.zeros(256, bool)
HARD[0xC6:] = True  # other scripts and signs
HARD[0x1C:0x20] = True  # white space for some
HARD[0xC2] = True  # signs, numbers and spaces of Latin-1
#: Of these, what is neither letter, number nor white space: second bytes after 0xC2, and third bytes after 0xE2 0x80 (dashes,
#: quotation marks, ellipsis).
SIGN, DASH = np.zeros(256, bool), np.zeros(256, bool)
SIGN[0xA1:0xC0] = True
SIGN[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = False
DASH[0x90:0xA8] = True


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Which characters aren't assigned yet as far as Python knows: the two libraries know them from different editions."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


class ByteBpe:
    """A tokenizer file's ids by pre-token. Files with a normaliser, dropout or another pre-tokeniser are refused."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout") and not spec["normalizer"]
        added = spec["added_tokens"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        special = {t["content"]: t["id"] for t in added}
        self.special = regex.compile("|".join(sorted(map(regex.escape, special), key=len, reverse=True))) if special else None
        self.special_bytes = [s.encode() for s in special]
        self.model = self.library.model
        self.whole = self.prove() | special
        self.table = PieceTable(len(self.whole) + MEMORY)
        data, at = text_buffer(pa.array(list(self.whole), pa.string()))
        self.table.put(hash_words(data, at[:-1], at[1:]), np.ones(len(self.whole), np.int64), np.fromiter(self.whole.values(), np.uint32, len(self.whole)), np.ones(len(self.whole), np.uint8))
        self.table.keep()

    def prove(self) -> dict[str, int]:
        """The vocabulary strings that alone encode as one token, by trying each."""
        size = self.library.get_vocab_size()
        strings = [s for s in dict.fromkeys(self.library.decode([i], skip_special_tokens=False) for i in range(size)) if s]
        found = self.library.encode_batch_fast(strings, add_special_tokens=False)
        return {s: e.ids[0] for s, e in zip(strings, found, strict=True) if len(e.ids) == 1}

    def sizes(self, text: str) -> Iterator[list[int]]:
        """The bytes of each pre-token of a text, in lists: by the pattern, or by the library for characters that it may see otherwise."""
        strange = unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()

        def split(part: str) -> list[int]:
            if strange:  # the library writes a character for each byte
                return [len(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
            return [len(p.encode()) for p in PATTERN.findall(part)]

        parts = [text]
        if self.special is not None and (marks := self.special.findall(text)):
            rest = self.special.split(text)
            parts = [x for pair in zip(rest, [*marks, ""], strict=True) for x in pair]
        for k, part in enumerate(parts):
            if k % 2:
                if part:
                    yield [len(part.encode())]
                continue
            while len(part) > STRETCH and (cut := LONE_SPACE.search(part, STRETCH)):
                yield split(part[: cut.start()])
                part = part[cut.start() :]
            yield split(part)

    def begins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in some texts, one after the other in data."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind, first = KIND[data], np.zeros(n + 1, bool)
        first[at[:-1]] = True
        first = first[:n]
        sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[sign] = kind[sign + 1] = OTHER
        strange = HARD[data]
        two = np.flatnonzero((data[:-1] == 0xC2) & SIGN[data[1:]])
        kind[two] = kind[two + 1] = OTHER
        three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & DASH[data[2:]])
        kind[three] = kind[three + 1] = kind[three + 2] = OTHER
        strange[two] = strange[three] = False
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        white, last = kind == WHITE, np.append(first[1:], True)
        after_space = np.zeros(n, bool)
        after_space[1:] = (data[:-1] == 0x20) & ~first[1:]
        start = change & (white | ~after_space)
        start[:-1] |= white[:-1] & ~white[1:] & ~last[:-1]  # the last white space before something
        # 's 't 'm 'd 're 've 'll, where the apostrophe begins a pre-token.
        mark = np.flatnonzero((data == 0x27) & start & ~last)
        mark = mark[~white[mark + 1] & (kind[mark + 1] == LETTER)]
        a, b = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~last[mark + 1] & (mark + 2 < n)
        mark, size = mark[one | two], np.where(one, 2, 3)[one | two]
        start[mark + 1] = False
        end = mark + size
        end = end[end < n]
        start[end[(kind[end] == LETTER) & ~first[end]]] = True
        # Texts that need the pattern.
        hard = sums(strange, np.diff(at)) > 0
        for s in self.special_bytes:
            raw = data.tobytes()
            found = raw.find(s)
            while found >= 0:
                hard[np.searchsorted(at, found, "right") - 1] = True
                found = raw.find(s, found + 1)
        for k in np.flatnonzero(hard).tolist():
            own = data[at[k] : at[k + 1]]
            sizes = np.cumsum(list(chain.from_iterable(self.sizes(own.tobytes().decode()))))
            start[at[k] : at[k + 1]] = False
            start[at[k] + np.concatenate([[0], sizes[:-1]]).astype(np.int64)] = True
        return np.flatnonzero(start)

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each pre-token, pre-tokens of each text)."""
        data, at = text_buffer(column)
        begin = self.begins(data, at)
        end = np.append(begin[1:], len(data))

        def learn(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = begin[which], end[which]
            size = b - a
            to = np.cumsum(size)
            mapped = STANDS[data[np.arange(int(to[-1])) + np.repeat(a - (to - size), size)]].tobytes().decode("utf-16-le")
            found = [[t.id for t in self.model.tokenize(mapped[x:y])] for x, y in zip((to - size).tolist(), to.tolist(), strict=True)]
            length = np.fromiter(map(len, found), np.int64, len(found))
            return length, np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), np.zeros(len(found), np.uint8)

        return self.table.look_up(hash_words(data, begin, end), learn), np.diff(np.searchsorted(begin, at))

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, of which were pre-tokens that are proven whole tokens)."""
        numbers, sizes = self.numbers(column)
        return sums(self.table.length[numbers], sizes), sums(self.table.flag[numbers].astype(np.int64), sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each)."""
        numbers, sizes = self.numbers(column)
        ids, length = self.table.gather(numbers)
        return ids, sums(length, sizes)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker and file."""
    return ByteBpe(path)


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than limit), n_whole (pre-tokens that are proven whole tokens) of each row."""
    docs = bounded(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                n, whole = byte_bpe(path).counts(some.column("text"))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit), pa.array(whole, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
