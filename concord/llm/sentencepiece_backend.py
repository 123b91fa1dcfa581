"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, byte fallback and the model itself (unigram scores, or merges
for a BPE model) are rebuilt as a tokenizers pipeline. No piece has the marker after another character (this is checked), so a
normalised text falls apart into segments, each a run of markers and what follows up to the next: segments are encoded alone, in
batches that the library spreads over threads, each distinct one once for a worker's bounded memory of them. All ids come from
that pipeline. Parity is verified on the way: segments whose checksum is divisible by CHECK, which are all, are also encoded by the sentencepiece
library itself, and a document counts those of its segments whose ids differ. The ids of each whole document
are decoded again by the tokenizers library and held against its normalised text.

Defined results: a null or empty text has no ids and decodes to an empty text; unknown characters become byte pieces, or the
unknown id where a model has none, and such a text doesn't round-trip; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pieces, text_buffer
from .piece_table import PieceTable, sums
from .words import hash_words

MARK = "▁"
#: Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct segments that a worker remembers, and threads of a batch.
MEMORY, THREADS = 1_000_000, 2
#: One of so many distinct segments is also encoded by sentencepiece, to verify parity.
CHECK = 1


def fields(raw: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of each field of a protobuf message; nested messages and strings are bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = raw[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        elif kind == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            raise ValueError(f"field type {kind}")
        yield tag >> 3, value


class Model:
    """What a model file says: pieces (text, score, kind), kind of model, normaliser."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, Any] = {}
        normalizer: dict[int, Any] = {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        kinds = [p[2] for p in self.pieces]
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else None
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0) or USER_DEFINED in kinds or not self.escape or not self.dummy_prefix:
            raise ValueError("only unigram and BPE models with a dummy prefix and without user-defined pieces or suffix markers")
        if any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL):
            raise ValueError("a piece has the marker inside")


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges that lead to each piece of a BPE model, best score first.

    sentencepiece does the leftmost of merges with one score first. Runs of markers share one: there that means that the run on the
    left grows as long as it can before another begins, so of these merges the one with the longest left part comes first.
    """
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, UNUSED)}
    number = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                run = not piece.strip(MARK)
                found.append((-s, run, -cut if run else number[piece], len(right) if run else number[left], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: Model):
    """The model as a tokenizers pipeline that takes a segment without its first marker."""
    import tokenizers as tk

    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        unknown = model.pieces[model.unknown][0] if model.unknown is not None else None
        core = tk.models.BPE(vocabulary, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = tk.models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    tokenizer = tk.Tokenizer(core)
    tokenizer.normalizer = tk.normalizers.Sequence([tk.normalizers.Prepend(MARK), tk.normalizers.Replace(" ", MARK)])
    tokenizer.decoder = tk.decoders.Sequence([tk.decoders.Replace(MARK, " "), tk.decoders.ByteFallback(), tk.decoders.Fuse()])
    return tokenizer


class Backend:
    """Encoding and decoding of texts with one model file."""

    def __init__(self, path: str, threads: int = THREADS, check: int = CHECK):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        import sentencepiece
        import tokenizers as tk

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.library = rebuild(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.charsmap = tk.normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.threads, self.check = threads, check
        self.table = PieceTable(MEMORY)

    def normal(self, text: str) -> str:
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text

    def mark_ids(self) -> list[int]:
        number = {p: i for i, (p, _, _) in enumerate(self.model.pieces)}
        if MARK in number:
            return [number[MARK]]
        return [number[f"<0x{b:02X}>"] for b in MARK.encode()] if self.model.byte_fallback else [self.model.unknown]

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of each segment, all ids, 1 where sentencepiece was asked and has others). new: segments without their first marker, the others as spaces."""
        found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        if "" in new:  # a marker alone, at the end of a text: the library takes the empty text for nothing
            found[new.index("")] = self.mark_ids()
        length = np.fromiter(map(len, found), np.int64, len(found))
        differs = np.zeros(len(new), np.uint8)
        asked = [i for i, s in enumerate(new) if s and zlib.crc32(s.encode()) % self.check == 0] if self.check else []
        for i, right in zip(asked, self.judge.encode([new[i] for i in asked], num_threads=self.threads), strict=True):
            differs[i] = found[i] != right
        return length, np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum())), differs

    def segments(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data, starts, ends, segments of each text): a segment without its first marker, the other markers as spaces."""
        data, at = text_buffer(column)
        marked = data.tobytes()
        if self.model.squeeze or self.charsmap is not None or MARK.encode() in marked:
            texts = [self.normal(t).replace(MARK, " ") if t else "" for t in column.to_pylist()]
            data, at = text_buffer(pa.array(texts, pa.string()))
        space = data == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[at[:-1][at[:-1] < len(data)]] = False  # the marker that is put before a text belongs to what follows
        cut = np.flatnonzero(opens)
        full = at[:-1][np.diff(at) > 0]
        starts = np.sort(np.concatenate([full, cut + 1]))
        # A segment ends where the next one's marker is, or with its text.
        ends = np.sort(np.concatenate([cut, at[1:][np.diff(at) > 0]]))
        sizes = np.zeros(len(at) - 1, np.int64)
        sizes[np.diff(at) > 0] = 1 + np.diff(np.searchsorted(cut, np.append(full, len(data))))
        return data, starts, ends, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, and for each text: ids, segments whose ids are known to differ from sentencepiece's, whether its ids decode to its normalised text)."""
        data, starts, ends, sizes = self.segments(column)

        def learn(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            raw = data.tobytes()
            return self.learn([raw[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])

        numbers = self.table.look_up(hash_words(data, starts, ends), learn)
        ids, length = self.table.gather(numbers)
        n = sums(length, sizes)
        at = np.concatenate([[0], np.cumsum(n)]).tolist()
        back = self.decode([ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)])
        same = np.fromiter((self.normal(t or "").replace(MARK, " ") == u for t, u in zip(column.to_pylist(), back, strict=True)), bool, len(n))
        return ids, n, sums(self.table.flag[numbers].astype(np.int64), sizes), same

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids: the first marker, which encoding adds, is taken off."""
        return [t.removeprefix(" ") for t in self.library.decode_batch(ids, skip_special_tokens=False)]


@lru_cache(maxsize=2)
def backend(path: str, threads: int = THREADS, check: int = CHECK) -> Backend:
    """One for each worker and file."""
    return Backend(path, threads, check)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, threads: int, check: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for some in pieces(batch, "text"):
            yield some, *backend(path, threads, check).encode(some.column("text"))


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", threads: int = THREADS, check: int = CHECK) -> DataFrame:
    """doc_id, ids, n_tokens, n_differ (segments whose ids sentencepiece was asked for and has others), round_trip (the ids decode to the normalised text) of each row."""
    docs = bounded(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, ids, n, differ, back in _encoded(batches, path, threads, check):
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.array(n, pa.int64()), pa.array(differ.astype(np.int64)), pa.array(back)], ["doc_id", "ids", "n_tokens", "n_differ", "round_trip"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, n_differ long, round_trip boolean")


def decode(encoded: DataFrame, path: str, *, doc_id: str = "doc_id", ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """doc_id, text of each row of ids; null is as no ids, the empty text."""
    encoded = bounded(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = backend(path, threads).decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", threads: int = THREADS, check: int = CHECK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), n_differ (segments whose ids sentencepiece was asked for and has others), round_trip (the ids decode to the normalised text)."""
    docs = bounded(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, ids, n, differ, back in _encoded(batches, path, threads, check):
            ends, raw = np.cumsum(n), memoryview(np.ascontiguousarray(ids, "<u4"))
            crc = [zlib.crc32(raw[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(differ.astype(np.int64)), pa.array(back)], ["doc_id", "n_tokens", "ids_crc32", "n_differ", "round_trip"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, n_differ long, round_trip boolean")
