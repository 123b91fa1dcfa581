"""Token counts, token files and the SentencePiece backend against the libraries themselves."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm import byte_bpe, sentencepiece_backend, token_files

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n\n", "a", "Hello world", "it's  they're\t\tdon't 12345 x²", "naïve café 日本語 🙂🙂", "a" * 300, " " * 40 + "b" + " " * 17, "x" + " " * 18 + "y",
    "<|endoftext|>", "one<|endoftext|> two<|endoftext|>", "<s>x</s> <unk> <0x41>", "tab\there\r\nand nbsp em", "▁under ▁▁x", "the the the", " lead", "trail ", "\x00\x01é̀", "'s'S 's", "ﬁ Ⅷ ①",
]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "other", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, start int")


def expected(text):
    return Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids


def test_counts_match_the_library(spark):
    found = {r.doc_id: r for r in byte_bpe.token_counts(rows(spark), JSON, limit=3).collect()}
    for k, t in enumerate(TEXTS):
        n = len(expected(t))
        assert (found[k].n_tokens, found[k].n_bytes, found[k].over_limit) == (n, len((t or "").encode()), n > 3), t
    assert byte_bpe.token_counts(rows(spark, []), JSON).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abrevlstmd ''.\n\t1<|endoftext|>éÉ×÷ßñ", max_size=60), min_size=1, max_size=4))
def test_ids_match_the_library_on_any_text(texts):
    bpe = byte_bpe.byte_bpe(JSON)
    column = pa.array(texts, pa.string())
    ids, n = bpe.encode(column)
    assert np.split(ids, np.cumsum(n))[:-1].__len__() == len(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [expected(t) for t in texts]
    assert bpe.counts(column)[0].tolist() == n.tolist()


def test_every_character_of_the_fast_path():
    """Each character up to U+2FFF, and of blocks with new letters, between letters, digits, spaces and signs, as the library splits it."""
    bpe = byte_bpe.byte_bpe(JSON)
    library = Tokenizer.from_file(JSON)
    texts = [f"ab{c}cd 1{c}2 {c} {c}{c}'s.{c}é{c}" for c in map(chr, [*range(0x3000), *range(0xA700, 0xABFF), *range(0x10900, 0x10F00), *range(0x18D00, 0x18E10), *range(0x1E600, 0x1E700)])]
    ids, n = bpe.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_long_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 50)
    monkeypatch.setattr(byte_bpe, "MEMORY", 5)
    bpe = byte_bpe.ByteBpe(JSON)
    for t in ["wörter und  mehr wørds " * 40, "don't  stop\n\n now " * 30, "x" * 500]:
        assert bpe.encode(pa.array([t, "", "and more"]))[0].tolist()[: len(expected(t))] == expected(t)


@given(st.lists(st.integers(0, 60000), min_size=1, max_size=2000), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_files_round_trip(ids, docs):
    ids = np.array(ids, np.uint32)
    lengths = np.diff(np.linspace(0, len(ids), docs + 1).astype(int))
    raw = token_files.to_bytes(ids, lengths, np.arange(docs), 0)
    held = token_files.TokenFile(raw)
    assert np.array_equal(np.concatenate(list(held.documents())), ids)


def test_any_block_decodes_alone_and_damage_shows(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    ids = np.random.default_rng(1).zipf(1.3, 5500).clip(0, 50000).astype(np.uint32)
    raw = token_files.to_bytes(ids, np.array([5500]), np.array([7]), 0)
    held = token_files.TokenFile(raw)
    assert np.array_equal(held.block(3), ids[3000:4000]) and np.array_equal(held.block(5), ids[5000:])
    assert len(raw) < 2 * len(ids) + 8 * len(held.symbols) + 3000
    broken = bytearray(raw)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(broken)).block(5)
    with pytest.raises(ValueError):
        token_files.TokenFile(raw[:16] + b"x" + raw[17:])


def test_token_files_end_to_end(spark, monkeypatch):
    data = [(5, "b"), (None, "null id"), (3, None), (9, "z " * 50), (3, "again"), (-2, "<|endoftext|>")]
    docs = spark.createDataFrame([(k, t, k) for k, t in data], "doc_id long, text string, start long")
    manifest = token_files.write_token_files(docs, token_files.token_folder(spark), JSON, 2, partitions=3)
    full = token_files.read_token_files(manifest).collect()
    short = {(r.doc_id, r.start): r for r in token_files.read_digests(manifest).collect()}
    at, order = 0, sorted(full, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, -2, 3, 3, 5, 9]
    for r in order:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert short[r.doc_id, r.start].ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))
        at += r.n_tokens
    assert sorted(map(str, (r.ids[:-1] for r in full))) == sorted(map(str, (expected(t) for _, t in data)))
    empty = token_files.write_token_files(docs.limit(0), token_files.token_folder(spark), JSON, 2)
    assert token_files.read_digests(empty).collect() == []


def test_sentencepiece_parity(spark):
    judge = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {r.doc_id: r.ids for r in sentencepiece_backend.encode(rows(spark), MODEL).collect()}
    assert {k: judge.encode(t or "") for k, t in enumerate(TEXTS)} == ids
    back = {r.doc_id: r.text for r in sentencepiece_backend.decode(sentencepiece_backend.encode(rows(spark), MODEL), MODEL).collect()}
    for k, t in enumerate(TEXTS):
        assert back[k] == (t or "").replace("▁", " "), t
    for r in sentencepiece_backend.encode(rows(spark), MODEL, check=1).collect():
        assert (r.n_tokens, r.n_differ, r.round_trip) == (len(r.ids), 0, True)
    column = pa.array(["a b", None, " ", "", "  x  y ", "z"])
    parts, n, _, _ = sentencepiece_backend.backend(MODEL, 1).encode(column)
    assert [p.tolist() for p in np.split(parts, np.cumsum(n))[:-1]] == [judge.encode(t or "") for t in column.to_pylist()]
    short = {r.doc_id: r for r in sentencepiece_backend.digests(rows(spark), MODEL).collect()}
    for k, x in ids.items():
        assert (short[k].n_tokens, short[k].ids_crc32) == (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x)))
        assert short[k].round_trip
    assert sentencepiece_backend.digests(rows(spark, []), MODEL).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("ab  .\n1é▁", max_size=80))
def test_sentencepiece_parity_on_any_text(text):
    judge = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    back = sentencepiece_backend.backend(MODEL, 1)
    ids, n, _, whole = back.encode(pa.array([text]))
    assert ids.tolist() == judge.encode(text) and n.tolist() == [len(ids)] and whole.all()


class Mute:
    """A judge that knows nothing: ids must not come from it."""

    def encode(self, texts, **_):
        return [[0] for _ in texts]


def test_ids_come_from_the_rebuilt_pipeline():
    judge, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_backend.Backend(MODEL, 1, 1)
    ours.judge = Mute()
    for t in TEXTS:
        ids, _, differ, whole = ours.encode(pa.array([t], pa.string()))
        assert ids.tolist() == judge.encode(t or "") and whole.all(), t
        assert bool(differ[0]) == bool((t or "").strip(" ")) or not (t or "").strip(" "), t


def test_runs_of_spaces():
    """Pieces of runs share one score, so that their order is a matter of place."""
    judge, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_backend.Backend(MODEL, 1, 1)
    texts = [before + " " * n + after for n in range(1, 80) for before in ("", "a", "x.") for after in ("", "b", "Word", "é")]
    ids, n, differ, whole = ours.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == judge.encode(texts)
    assert not differ.any() and whole.all()


def proto(*parts):
    """A protobuf message of (field, value): bytes, floats or ints."""

    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    out = b""
    for number, v in parts:
        if isinstance(v, bytes):
            out += varint(number << 3 | 2) + varint(len(v)) + v
        elif isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(number << 3) + varint(v)
    return out


def test_a_unigram_model_matches_sentencepiece(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256))]
    pieces += [(p, s, 1) for p, s in [("▁", -3.0), ("▁a", -2.5), ("a", -3.1), ("b", -3.2), ("ab", -4.0), ("▁ab", -3.5), ("aba", -4.2), ("▁▁", -5.0), ("ba", -4.1), ("é", -6.0)]]
    raw = proto(*((1, proto((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces), (2, proto((3, 1), (35, 1))), (3, proto((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    judge, ours = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_backend.Backend(str(path), 1)
    for text in ["ab abab", "a", " baab", "abaabbb éx", "b  a", "zz"]:
        ids, _, differ, whole = ours.encode(pa.array([text]))
        assert ids.tolist() == judge.encode(text) and whole.all() and not differ.any(), text


def test_a_unigram_model_that_squeezes(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256))]
    pieces += [(p, s, 1) for p, s in [("▁", -3.0), ("▁a", -2.5), ("a", -3.1), ("b", -3.2), ("ab", -4.0), ("▁ab", -3.5), ("ba", -4.1)]]
    raw = proto(*((1, proto((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces), (2, proto((3, 1), (35, 1))), (3, proto((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "squeeze.model"
    path.write_bytes(raw)
    judge, ours = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_backend.Backend(str(path), 1, 1)
    for text in ["ab  abab", " a ", "  ba   ab  ", "   ", "z  a"]:
        ids, _, differ, whole = ours.encode(pa.array([text]))
        assert ids.tolist() == judge.encode(text) and whole.all() and not differ.any(), text


def test_every_segment_is_verified():
    """A library that always disagrees is noticed for each segment, not for some."""
    backend = sentencepiece_backend.Backend(MODEL)
    backend.judge = type("Other", (), {"encode": lambda self, texts, num_threads: [[-1]] * len(texts)})()
    assert backend.learn([f"word{k}" for k in range(100)])[2].tolist() == [1] * 100
