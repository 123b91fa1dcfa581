"""Queries that take whole tables and whole texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from concord import queries
from concord.operators import relations


def test_pages_of_all_documents_and_whole_texts(spark, tmp_path):
    texts = {1: "short", 7: "".join(chr(33 + k % 90) for k in range(2503)), 5000: "beyond 4000 " * 100, 1_000_003: "x" * 960, 1_000_004: "\n"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(d, 1 + k // 40): t[k : k + 40].ljust(40) for d, t in texts.items() if d != 1_000_004 for k in range(0, len(t), 40)}
    got = queries.D01_rt_pages(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.row): r.text for r in got} == want


@pytest.mark.parametrize(("name", "byte"), [("E01_rt_hamming84", 600), ("E12_rt_difference_set", 600), ("E13_rt_product_code", 2000)])
def test_round_trips_are_of_whole_texts(spark, tmp_path, monkeypatch, name, byte):
    """Damage that can't be mended, far behind the first 60 characters, is noticed."""
    texts = {1: "short", 2: "some words " * 200}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = getattr(queries, name)
    assert {r.doc_id: r.payload for r in run(spark, str(tmp_path)).collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
    junk = F.unhex(F.lit("5A0F33C1" * 80))
    monkeypatch.setattr(queries.K, "damage", lambda sent, seed, kind: F.when(F.length(sent) > byte + 320, F.overlay(sent, junk, F.lit(byte))).otherwise(sent))
    found = {r.doc_id: r.payload for r in run(spark, str(tmp_path)).collect()}
    assert found[1] == hashlib.sha256(b"short").hexdigest() and found[2] != hashlib.sha256(texts[2].encode()).hexdigest()


def test_chains_go_to_their_end(spark):
    links = spark.createDataFrame([(k, k + 1 if k < 1500 else None) for k in range(1501)] + [(9000, 9001), (9001, 9000)], "k long, nx long")
    got = relations.chain(links, "k", "nx", spark.createDataFrame([(0,), (1498,)], "k long")).collect()
    assert sorted(map(tuple, got)) == [(0, k, k) for k in range(1501)] + [(1498, 1498 + k, k) for k in range(3)]
    with pytest.raises(ValueError, match="itself"):
        relations.chain(links, "k", "nx", spark.createDataFrame([(9000,)], "k long"))


def test_chains_of_all_orders(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 401)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.start, r.k) for r in queries.J16_continuation_chain(spark, str(tmp_path)).collect()}
    assert got == {(s, s << n) for s in range(1, 401, 2) for n in range(9) if s << n <= 400}


def test_all_documents_can_be_orphans(spark, tmp_path):
    text = "first line\nsecond line\nthird line"
    spark.createDataFrame([(1, "s", "en", text), (7, "s", "en", text)], "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.G04_own_orphans(spark, str(tmp_path)).collect())) == [(1, "en", 3), (7, "en", 3)]


def test_files_from_whole_texts(spark, tmp_path):
    texts = [f"{k} a block of a whole text, longer than ten characters" for k in range(5)]
    spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = queries.D24_files_from_blocks(spark, str(tmp_path)).first()
    assert (r.data, r.blocks, r.whole) == (hashlib.sha256("".join(texts).encode()).hexdigest(), 5, True)


def test_equal_ends_of_pieces_far_apart(spark):
    """Two files with the same end of a piece by chance, and a third that begins as the second ends."""
    rows = [(0, "aaaaXY"), (2, "XYbbbb"), (100, "ccccXY"), (102, "XYddZZ"), (200, "ZZeeee")]
    got = relations.chain_pieces(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2, within=7).collect()
    assert sorted(map(tuple, got)) == [(0, "aaaaXYbbbb", 2), (100, "ccccXYddZZ", 2), (200, "ZZeeee", 1)]
