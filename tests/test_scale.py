"""Operators whose plans must not grow with the square of a key or a text, against brute force; and what they leave of the session."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators import relations, similarity, timeline, votes
from concord.plans import work


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_of_short_and_long_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["".join(rng.choice("ab") for _ in range(40)) for _ in range(20)]
    texts += [t[:20] + "#" + t[21:] for t in texts[60:70]]
    found = similarity.block_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()
    one = {}
    for k, t in enumerate(texts):
        one.setdefault(t[:40].ljust(40), k)
    keys = [(k, t) for t, k in one.items()]
    want = {(min(a, b), max(a, b), d) for i, (a, x) in enumerate(keys) for b, y in keys[:i] if (d := sum(p != q for p, q in zip(x, y, strict=True))) <= 3}
    assert len(found) == len(want) and set(map(tuple, found)) == want


def test_blank_blocks_are_no_candidates(spark):
    """Short names that differ everywhere share the spaces after them, and nothing else."""
    rows = spark.createDataFrame([(k, f"{k:06d}"[::-1]) for k in range(300)], "k long, t string")
    assert similarity.block_pairs(rows, "k", "t", most=0).count() == 0


def test_texts_in_a_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcde") for _ in range(5000))
    loose = [long[990:1020], long[4990:], long[:9], long[10:19] + "#", "short", "x" * 30, None, long[990:1020]]
    known = spark.createDataFrame([(long,), (None,), ("tiny",)], "whole string")
    found = relations.not_contained(spark.createDataFrame([(t,) for t in loose], "t string"), "t", known, "whole", gram=8, size=100).collect()
    want = [t for t in loose if t is None or len(t) < 8 or t not in long]
    assert sorted(str(r.t) for r in found) == sorted(map(str, want))


def test_repeated_rows_keep_their_prefixes(spark):
    left = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (2, "a"), (3, None)], "k long, t string")
    found = relations.prefix_match(left, spark.createDataFrame([("ab",), ("abcd",), ("a",), ("",)], "p string"), "t", "p").collect()
    assert sorted((r.k, r.p) for r in found) == [(1, "a")] * 2 + [(1, "ab")] * 2 + [(1, "abcd")] * 2 + [(2, "a")]


def test_the_nearest_row_either_way(spark):
    rng = random.Random(4)
    left = [(k, rng.randint(0, 3), rng.randint(0, 400)) for k in range(200)]
    right = [(g, t, f"{g}-{t}") for g in range(4) for t in rng.sample(range(400), 20)]
    found = timeline.nearest(spark.createDataFrame(left, "k long, g long, t long"), spark.createDataFrame(right, "g long, t long, v string"), ["g"], "t", "v", 9).collect()
    best = {k: min(((abs(t - u), u, v) for h, u, v in right if h == g), default=None) for k, g, t in left}
    assert len(found) == len(left) and {r.k: (r.v, r.distance) for r in found} == {k: (b[2], b[0]) if b[0] <= 9 else (None, None) for k, b in best.items()}


def test_a_fill_from_the_nearest(spark):
    left = spark.createDataFrame([(1, 5, None), (1, 5, None), (1, 9, "own"), (2, 3, None)], "k long, t long, v string")
    right = spark.createDataFrame([(1, 4, "a"), (1, 7, "b"), (3, 8, "late"), (3, 2, "early")], "k long, t long, v string")
    found = relations.fill_from_nearest(left, right, ["k"], "v", "t").collect()
    assert sorted((r.k, -1 if r.t is None else r.t, r.v) for r in found if r.v) == [(1, 5, "a"), (1, 9, "own"), (3, -1, "early")] and len(found) == 4


def test_a_clock_that_runs_fast_is_fitted(spark):
    rng = random.Random(5)
    rows = [(1, float(x), 40 + 3.5 * x + (5000 if rng.random() < 0.2 else rng.random())) for x in range(400)]
    r = votes.robust_fit(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y", 30).first()
    assert abs(r.slope - 3.5) < 0.01 and 250 < r.n < 400


def test_rows_in_two_versions_are_not_foreign(spark):
    rows = [("p", "logo", v) for v in (1, 2, 3) * 4] + [("q", "logo", 1), ("q", "logo", 2), ("r", "logo", 1)]
    df = spark.createDataFrame(rows, "page string, row string, v long")
    pages = lambda **more: sorted(r.page for r in votes.foreign_rows(df, "page", "row", **more).collect())
    assert pages(versions="v") == ["p", "q"] and pages() == ["p"] and pages(clean=True) == ["p", "q", "r"]


class Cluster:
    """A session without a shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master = {}, self, master


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            work.shared_dir(Cluster(master))
    assert work.shared_dir(type("S", (), {"conf": {"spark.checkpoint.dir": "hdfs://x/y/"}})()) == "hdfs://x/y"


def test_settings_of_an_own_session_stay_there(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before, df = spark.conf.get(key), spark.range(3)
    own = work.own_session(df, {key: "77"})
    assert own.sparkSession.conf.get(key) == "77" and spark.conf.get(key) == before
    assert own.join(df, "id").count() == 3 and own.filter(F.col("id") > 0).count() == 2


def test_overlaps_are_dealt_over_tasks_and_far_pairs_left_out_first(spark):
    """One file of texts is worked through by more than one task; pairs at the limit of what may differ are kept, one place more is not."""
    base = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=200))

    def bent(places):
        return "".join("#" if k in places else c for k, c in enumerate(base[60:180]))

    rows = [(1, base[:120]), (2, bent({8, 20, 32, 44, 56})), (3, bent({8, 20, 32, 44, 56, 57})), (4, bent({8, 9, 10, 11, 12, 13})), (5, base[60:71]), (6, base[60:70] + "#"), (7, base[60:71] + "#")]
    got = similarity.gram_overlaps(spark.createDataFrame(rows, "k long, t string").coalesce(1), "k", "t")
    assert {(r.a, r.b, r["at"], r.overlap) for r in got.collect() if r.a == 1} == {(1, 2, 60, 60), (1, 5, 60, 11), (1, 7, 60, 12)}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("letters", ["ab", "aéš字\U0001f600"])
def test_pairs_that_share_a_gram_become_no_rows(spark, letters):
    """Overlaps as by brute force, also of characters beyond a byte and of keys with several texts; the plan joins nothing, so pairs that are unlike stay out of rows."""
    rng = random.Random(5)
    stem = [rng.choice(letters) for _ in range(60)]
    rows = []
    for k in range(150):
        start = rng.randint(0, 30)
        t = stem[start : start + rng.randint(6, 40)]
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = rng.choice(letters)
        rows.append((k % 140, "".join(t)))
    frame = spark.createDataFrame([*rows, (None, "".join(stem)), (999, None)], "k long, t string")
    got = similarity.gram_overlaps(frame, "k", "t")
    want = {}
    for a, x in rows:
        for b, y in rows:
            for at in range(len(x) - 7) if a != b and len(y) >= 8 else ():
                n = min(len(x) - at, len(y))
                if x[at : at + 8] == y[:8] and sum(p != q for p, q in zip(x[at : at + n], y[:n], strict=True)) * 12 <= n:
                    want[a, b] = max(want.get((a, b), (0, 0)), (n, -at))
    assert len(want) > 1000 and sorted((r.a, r.b, r.overlap, -r["at"]) for r in got.collect()) == sorted((*k, *v) for k, v in want.items())
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_points_of_one_place_are_joined_once(spark, tmp_path):
    """The result as by brute force, for columns that may be null, repeated rows and places with more points than go together; and small in a file, as its rows come in runs."""
    rng = random.Random(6)
    points = [(rng.randint(0, 1), rng.choice([None, *range(30), *[7] * 30]), rng.choice([None, 1, 2]), rng.choice("xy")) for _ in range(300)]
    spans = [(rng.randint(0, 1), start := rng.randint(0, 25), start + rng.randint(-1, 9), k) for k in range(60)]
    right = spark.createDataFrame(spans, "g long, a long, z long, s long")
    for columns in ([0, 1, 2, 3], [0, 1, 2], [0, 1]):
        names = ["g long", "m long", "v long", "w string"]
        left = spark.createDataFrame([tuple(p[c] for c in columns) for p in points], ", ".join(names[c] for c in columns))
        got = timeline.in_interval(left, right, ["g"], "m", "a", "z", 5, 20)
        want = [(*[p[c] for c in columns], *s[1:]) for p in points for s in spans if p[0] == s[0] and p[1] is not None and s[1] <= p[1] < s[2]]
        assert got.columns == [*left.columns, "a", "z", "s"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    dense = timeline.in_interval(spark.range(64).selectExpr("id AS e", "id % 2 AS m"), spark.range(6000).selectExpr("id AS s", "0L AS a", "2 + id % 2 AS z").hint("merge"), [], "m", "a", "z", 60)
    dense.select("e", "s").write.parquet(f"{tmp_path}/dense")
    size = sum(f.stat().st_size for f in (tmp_path / "dense").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/dense").count() == 64 * 6000 and size < 64 * 6000 / 4
