"""Near duplicates, repeated passages and benchmark leaks against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from concord.llm import common, decontaminate, near_dedup, substring_dedup, words
from tests.llm import util


def noisy(seed, n=60):
    """Texts with copies, near copies, shared passages, junk, empties and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", "  \n ", "one", "One", "two words", "junk " * 60, "junk " * 61, "x" * 500]
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        kind = rng.random()
        if kind < 0.25 and len(texts) > 12:
            w = (rng.choice(texts[9:]) or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.45:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randint(0, 9) :]
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(w if rng.random() < 0.8 else [x.upper() for x in w]))
    return texts


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "extra", 5, None) for d, t in rows], "doc_id long, text string, n string, k1 int, key string")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, seed, width):
    rows = [(1000 - 3 * i if i % 11 else None, t) for i, t in enumerate(noisy(seed))] + [(7, "same id"), (7, "same id"), (7, "other text here")]
    found = near_dedup.near_duplicates(documents(spark, rows), width=width).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, util.near_duplicates(rows, width)))


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).collect() == []
    assert near_dedup.deduplicate(documents(spark, [])).collect() == []


def test_one_row_of_each_group_stays(spark):
    rows = [(i, t) for i, t in enumerate(noisy(3))] + [(2000, "a b c d e f"), (2000, "a b c d e f"), (None, "a b c d e f")]
    docs = documents(spark, rows)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    want = [(d, t) for (d, t), (_, n, c, k) in zip(rows, util.near_duplicates(rows, 5), strict=True) if k and not (n and d == 2000)] + [(2000, "a b c d e f")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, want))


@pytest.mark.parametrize("finish", [1 << 16, 0])
@pytest.mark.parametrize("block", [256, 7])
def test_a_star_of_unlinked_members_is_searched_out(spark, monkeypatch, finish, block):
    monkeypatch.setattr(near_dedup, "FINISH", finish)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    # A chain: each text is near the next one only, and all share buckets with many others.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(len(base))] = f"v{i}{rng.random()}"
    report = {}
    found = near_dedup.near_duplicates(documents(spark, rows), report=report).collect()
    assert sorted(map(tuple, found)) == sorted(util.near_duplicates(rows, 5))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for size, share in ((12, 0.8), (60, 0.8), (900, 0.8), (900, 0.5)):
        same = 0
        for _ in range(20):
            pool = rng.integers(0, 2**63, 3 * size, dtype=np.uint64)
            common_part = int(size * 2 * share / (1 + share))
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:common_part], pool[size : 2 * size - common_part]]))
            s = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            same += (s[0] == s[1]).mean() / 20
        true = common_part / (2 * size - common_part)
        assert abs(same - true) < 0.08, (size, same, true)


@pytest.mark.parametrize("seed", [4, 6])
@pytest.mark.parametrize("hot", [False, True])
def test_repeated_passages(spark, monkeypatch, seed, hot):
    texts = noisy(seed, 120)
    rows = list(enumerate(texts))
    if hot:
        real = substring_dedup.frequent_minimisers

        def some_hot(docs, text, window):
            values = {int(v) for t in texts if t for v in substring_dedup.Texts(pa.array([t + " "]), window).runs()[3].view(np.int64)}
            return np.sort(np.array(sorted(values)[::2], np.int64).view(np.uint64)), real(docs, text, window)[1]

        monkeypatch.setattr(substring_dedup, "frequent_minimisers", some_hot)
    found = {r.row.doc_id: r for r in substring_dedup.remove_repeats(documents(spark, rows), window=12).collect()}
    for k, want in enumerate(util.repeats(texts, 12)):
        assert (found[k].n_words, found[k].n_removed, found[k].kept) == want, texts[k]
    assert found[3].row.n == "extra"


def test_untouched_texts_stay_as_they_were(spark):
    rows = [(1, "a  b\nc"), (2, "p q r s t u v"), (3, "x p q r s t u"), (4, None)]
    found = {r.row.doc_id: r.kept for r in substring_dedup.remove_repeats(documents(spark, rows), window=4, as_it_was=True).collect()}
    assert found == {1: "a  b\nc", 2: "v", 3: "x", 4: ""}
    assert substring_dedup.remove_repeats(documents(spark, [])).collect() == []
    only = spark.createDataFrame([("a b",)], "text string")
    assert substring_dedup.remove_repeats(only).first().kept == "a b"


@pytest.mark.parametrize("partitions", [4, 200])
def test_frequent_minimisers_are_found(spark, monkeypatch, partitions):
    """One passage in most texts, in few tasks or spread thin over many."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} tail{i}") for i in range(400)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(80))) for i in range(100)]
    docs = documents(spark, rows).repartition(partitions)
    assert len(substring_dedup.frequent_minimisers(docs, "text", 35)[0]) == 0  # all of it is far less than a bucket
    monkeypatch.setattr(substring_dedup, "BUCKET", 1 << 17)
    monkeypatch.setattr(substring_dedup, "STRIDE", 4)
    hot, buckets = substring_dedup.frequent_minimisers(docs, "text", 35)
    own = {int(v) for v in substring_dedup.Texts(pa.array([passage + " "]), 35).runs()[3]}
    assert len(hot) and {int(v) for v in hot} <= own and buckets >= 32
    found = {r.row.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert all(found[i].kept == f"tail{i}" for i in range(400)) and all(found[1000 + i].n_removed == 0 for i in range(100))


def test_buckets_are_read_in_parts(monkeypatch):
    texts = [f"x{i} " + " ".join(f"w{j}" for j in range(30)) + " " for i in range(40)]
    strings = substring_dedup.Texts(pa.array(texts), 10)
    doc, begin, windows, _ = strings.runs()
    a, b = strings.place[begin], strings.place[begin + windows + 9]
    squeeze = zstandard.ZstdCompressor()
    blobs = []
    for k in range(len(doc)):
        raw = strings.normal[a[k] : b[k]].tobytes()
        blobs.append(squeeze.compress(b"".join(np.array([x], "<i8").tobytes() for x in (1, doc[k], doc[k], begin[k] - strings.first[doc[k]], windows[k], len(raw))) + raw))
    whole = substring_dedup.count_bucket(blobs, 10).sort_by([("k1", "ascending"), ("start", "ascending")])
    monkeypatch.setattr(substring_dedup, "PART", 100)
    assert whole.equals(substring_dedup.count_bucket(blobs, 10).sort_by([("k1", "ascending"), ("start", "ascending")])) and whole.num_rows


def test_word_hashes_tell_words_apart():
    texts = ["a b c", "aaaaaaaa aaaaaaaaa", "x" * 9 + " " + "x" * 17, "é É", "", "tail"]
    data, at = common.text_buffer(pa.array(texts))
    starts, ends, first = words.split(data, at)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in t.split()]
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
    for stream in (0, 1):
        assert len(set(words.hash_words(data, starts, ends, stream).tolist())) == len(starts)


ITEMS = [(1, "alpha beta gamma delta"), (2, "Alpha, BETA gamma!"), (3, None), (4, "..."), (None, "null id item words"), (5, "one"), (5, "repeated id beta gamma delta epsilon"), (6, "éa éb éc éd")]
TEXTS = [None, "", "alpha beta gamma delta epsilon", "ALPHA-beta_gamma", "the one", "beta gamma delta epsilon zeta null id item words", "éa Éb éc", "ÉA éa éb éc éd", "alpha beta gamma alpha beta gamma delta", "x9 y8", "gamma delta"]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_leaks(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "SHINGLE", size)
    rows = list(enumerate([*TEXTS, *TEXTS]))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, rows), items, window=3).collect()}
    assert len(found) == len(rows)
    for (k, _), want in zip(rows, util.leaks([t for _, t in rows], ITEMS, 3), strict=True):
        assert (found[k].n_words, found[k].n_hit, found[k].items) == want
        assert found[k].contaminated == (want[1] > 0)
    kept = decontaminate.clean(documents(spark, rows), items, window=3)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, f in sorted(found.items()) if not f.contaminated]
    assert all(not r.contaminated for r in decontaminate.decontaminate(documents(spark, rows), items.limit(0)).collect())
    assert decontaminate.decontaminate(documents(spark, []), items).collect() == []


def test_leaks_in_noisy_texts(spark):
    texts = noisy(8, 80)
    items = [(i, " ".join((t or "").split()[3:16])) for i, t in enumerate(texts[9:40])]
    found = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, want in enumerate(util.leaks(texts, items, 10)):
        assert (found[k].n_words, found[k].n_hit, found[k].items) == want


def test_leaks_among_awkward_columns(spark):
    """Names with dots and names that clash, a very long text, many windows of one rare shingle, and items of one and two words."""
    passage = " ".join(f"q{i}" for i in range(40))
    texts = ["x y " * 40_000 + passage + " z", passage, None, "", "alpha", "alpha beta", "beta", "q1 q2 q3 q4 q5 q6 q7 q8 q9", "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"]
    docs = spark.createDataFrame([(i, t, "v", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string, k1 int, w int")
    items = [(1, passage), (2, "Alpha"), (3, "beta gamma"), (None, "beta")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(docs, table).collect()}
    for k, want in enumerate(util.leaks(texts, items, 10)):
        assert (found[k].n_words, found[k].n_hit, found[k].items) == want, k
    kept = decontaminate.clean(docs, table)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(len(texts)) if not found[k].n_hit]
