"""Files of token ids, compressed by a static range asymmetric numeral system.

A file holds whole documents in ascending order of id and one frequency table that all its blocks share. A block is up to BLOCK
tokens dealt to interleaved lanes, each with its own coder state; lanes make a step together, as one NumPy operation. The
directory has, for each block, where it begins and checksums of its bytes and of its ids, and the block begins with a checkpoint
of all lane states: any block is decoded alone. Documents are cut into files of at most FILE_TOKENS tokens, or one document.

    file: magic, header length (u32), header crc32 (u32), header (JSON), symbols (u32), frequencies (u32), document
          lengths (u64), document ids (i64), directory (blocks x 4 u32: tokens, payload bytes, crc32 of payload, of ids), payloads
    payload: lane states (u64), then 32-bit words in the order in which decoding takes them

Writing: rows are range-partitioned and sorted by id (ties by a hash of the text, nulls first), and every task writes its files
to a folder all machines see, under names of its own; the manifest that comes back names the files of the attempts that
counted, so a retried task leaves at most files that nothing names. Reading: `start` counts the ids of all documents before.

Defined results: a null or empty text is a document of the end id alone; repeated ids are documents of their own; an empty
table makes no files and reads as no rows. A damaged file raises ValueError.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import bounded, cut, pieces, work_path

MAGIC = b"CNCRANS1"
LANES, BLOCK, FILE_TOKENS, FILE_DOCS = 2048, 1 << 18, 1 << 21, 1 << 18
LOW = np.uint64(1 << 31)
U = np.uint64


def scaled(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies that sum to a power of two, each at least 1, and that power."""
    bits = min(24, max(12, int(np.ceil(np.log2(max(2, len(counts))))) + 4))
    room = (1 << bits) - len(counts)
    f = 1 + (counts.astype(np.float64) * room / counts.sum()).astype(np.int64)
    f[np.argmax(counts)] += (1 << bits) - f.sum()
    return f, bits


def encode_block(symbols: np.ndarray, f: np.ndarray, cum: np.ndarray, bits: int) -> bytes:
    """symbols: numbers of table entries."""
    lanes = max(1, min(LANES, len(symbols) // 32))
    steps = -(-len(symbols) // lanes)
    filled = np.full(steps * lanes, int(np.argmax(f)))
    filled[: len(symbols)] = symbols
    state, words = np.full(lanes, LOW, U), []
    shift, top = U(bits), U(63 - bits)
    for row in filled.reshape(steps, lanes)[::-1]:
        freq = f[row]
        full = state >= (freq << top)
        words.append(state[full].astype("<u4"))  # the low 32 bits
        state = np.where(full, state >> U(32), state)
        q = state // freq
        state = (q << shift) + (state - q * freq) + cum[row]
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(payload: bytes, n: int, f: np.ndarray, cum: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    lanes = max(1, min(LANES, n // 32))
    steps = -(-n // lanes)
    state = np.frombuffer(payload, "<u8", lanes).astype(U)
    words = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(U)
    out, at, shift, mask = np.empty((steps, lanes), np.int64), 0, U(bits), U((1 << bits) - 1)
    for k in range(steps):
        slot = state & mask
        out[k] = row = slots[slot]
        state = f[row] * (state >> shift) + slot - cum[row]
        low = np.flatnonzero(state < LOW)
        if len(low):
            state[low] = (state[low] << U(32)) | words[at : at + len(low)]
            at += len(low)
    if at != len(words):
        raise ValueError("a block has words left over")
    return out.reshape(-1)[:n]


def to_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, nulls: int) -> bytes:
    """A file. ids: of all documents, in order; doc_ids: the first `nulls` of them are null."""
    tally = np.bincount(ids)
    symbols = np.flatnonzero(tally)
    counts, number = tally[symbols], np.zeros(len(tally), np.int32)
    number[symbols] = np.arange(len(symbols))
    f, bits = scaled(counts)
    cum = np.cumsum(f) - f
    f64, cum64 = f.astype(U), cum.astype(U)
    payloads, directory = [], []
    for begin in range(0, len(ids), BLOCK):
        payload = encode_block(number[ids[begin : begin + BLOCK]], f64, cum64, bits)
        some = ids[begin : begin + BLOCK].astype("<u4")
        payloads.append(payload)
        directory.append((len(some), len(payload), zlib.crc32(payload), zlib.crc32(some)))
    header = json.dumps({"bits": bits, "symbols": len(symbols), "documents": len(lengths), "nulls": nulls, "blocks": len(directory), "tokens": len(ids)}).encode()
    tables = [symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(), lengths.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), np.array(directory, "<u4").tobytes()]
    crc = zlib.crc32(b"".join([header, *tables]))
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), crc.to_bytes(4, "little"), header, *tables, *payloads])


class TokenFile:
    """A file's tables, and its blocks one by one."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(raw[8:12], "little")
        self.header = h = json.loads(raw[16 : 16 + size])
        at = 16 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        self.symbols, f = take("<u4", h["symbols"]), take("<u4", h["symbols"])
        self.lengths, self.doc_ids = take("<u8", h["documents"]).astype(np.int64), take("<i8", h["documents"])
        self.directory = take("<u4", 4 * h["blocks"]).reshape(-1, 4)
        if zlib.crc32(raw[16:at]) != int.from_bytes(raw[12:16], "little"):
            raise ValueError("a token file's tables are damaged")
        self.raw, self.begin = raw, at + np.concatenate([[0], np.cumsum(self.directory[:, 1].astype(np.int64))])
        self.f, self.cum = f.astype(U), (np.cumsum(f.astype(np.int64)) - f).astype(U)
        self.slots = np.repeat(np.arange(len(f)), f)

    def block(self, k: int) -> np.ndarray:
        n, _, crc, ids_crc = (int(x) for x in self.directory[k])
        payload = self.raw[self.begin[k] : self.begin[k + 1]]
        if zlib.crc32(payload) != crc:
            raise ValueError(f"block {k} is damaged")
        ids = self.symbols[decode_block(payload, n, self.f, self.cum, self.slots, self.header["bits"])]
        if zlib.crc32(ids.astype("<u4")) != ids_crc:
            raise ValueError(f"block {k} decodes to other ids")
        return ids

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, in order; as many blocks are held as a document needs."""
        have, k = np.zeros(0, np.uint32), 0
        for n in self.lengths.tolist():
            parts, size = [have], len(have)
            while size < n:
                parts.append(self.block(k))
                size += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield have[:n]
            have = have[n:]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the files into folder, and return the manifest: part, seq (the order of files), file, n_docs, n_tokens.

    Ids of documents are 64-bit integers; what can't be cast to one counts as null. Nulls come first.
    """
    docs = bounded(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or max(8, rows.rdd.getNumPartitions())
    # Rows with one id can go to several files: by a hash of their text, and copies by their place in the input.
    order = ["doc_id", F.xxhash64("text"), "place"]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            keys = pa.concat_arrays([h[2] for h in held])
            name = f"part-{part:06d}-{seq:06d}-{attempt}.rans"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(ids, lengths, keys.fill_null(0).to_numpy(zero_copy_only=False), keys.null_count))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [f"{folder.rstrip('/')}/{name}"], "n_docs": [len(lengths)], "n_tokens": [len(ids)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            seq, held = seq + 1, []
            return row

        tokens = count = 0
        for batch in batches:
            for some in pieces(batch, "text"):
                ids, lengths = byte_bpe(path).encode(some.column("text"))
                ends = np.cumsum(lengths)
                held.append((np.insert(ids, ends, np.uint32(end_id)).astype(np.uint32), lengths + 1, some.column("doc_id")))
                tokens, count = tokens + len(ids) + len(lengths), count + len(lengths)
                if tokens >= FILE_TOKENS or count >= FILE_DOCS:
                    tokens = count = 0
                    yield flush()
        if held:
            yield flush()

    return cut(rows.mapInArrow(write, "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with start: the ids in all files before. What reaches the driver is one total a partition."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in totals]) if totals else []
    bases = spark.createDataFrame([(r.part, int(e - r.n)) for r, e in zip(totals, ends, strict=True)], "part int, base long")
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.join(bases, "part").withColumn("start", F.col("base") + before).select("file", "start", "n_docs", "n_tokens")


def _read(manifest: DataFrame, schema: str, make) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                with store.open_input_stream(name) as f:
                    held = TokenFile(f.read())
                yield make(held, row["start"])

    listed = with_starts(manifest)
    n = max(1, manifest.agg(F.count("*")).first()[0])
    return listed.repartition(min(n, 10_000)).mapInArrow(read, schema)


def _common(held: TokenFile, start: int) -> list[pa.Array]:
    empty = np.arange(len(held.lengths)) < held.header["nulls"]
    return [pa.array(held.doc_ids, pa.int64(), mask=empty), pa.array(start + np.cumsum(held.lengths) - held.lengths, pa.int64()), pa.array(held.lengths, pa.int64())]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files."""

    def make(held: TokenFile, start: int) -> pa.RecordBatch:
        ids = np.concatenate([*held.documents(), np.zeros(0, np.uint32)]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(held.lengths)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*_common(held, start), pa.ListArray.from_arrays(at, pa.array(ids))], ["doc_id", "start", "n_tokens", "ids"])

    return _read(manifest, "doc_id long, start long, n_tokens long, ids array<long>", make)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) of every document in the files."""

    def make(held: TokenFile, start: int) -> pa.RecordBatch:
        crc = [zlib.crc32(np.ascontiguousarray(ids, "<u4")) for ids in held.documents()]
        return pa.RecordBatch.from_arrays([*_common(held, start), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def token_folder(spark: SparkSession) -> str:
    """A new folder for files, in the shared one."""
    return work_path(spark, "tokens")
