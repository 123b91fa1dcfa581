"""Clusters of copies, folding, votes with slips, and the writers."""

import random

from pyspark.sql import functions as F

from concord import queries
from concord.operators import clusters
from concord.plans import sinks


def test_first_fit_follows_the_order_of_arrival(spark):
    rows = [("p", 1, "aaaa"), ("p", 2, "aaab"), ("p", 3, "aabb"), ("p", 4, "aabb"), ("p", 5, "zzzz"), ("q", 1, None)]
    df = spark.createDataFrame(rows, "page string, seq int, text string")
    got = {(r.page, r.seq): (r.cluster, r.members) for r in clusters.first_fit(df, ["page"], ["seq"], "text", width=4, most=1).collect()}
    assert got == {("p", 1): (1, 2), ("p", 2): (1, 2), ("p", 3): (2, 2), ("p", 4): (2, 2), ("p", 5): (3, 1), ("q", 1): (1, 1)}
    moved = {r.seq: r.cluster for r in clusters.first_fit(df.filter("page = 'p'"), ["page"], ["seq"], "text", width=4, most=1, least=2, recentre=True).collect()}
    assert moved == {1: 1, 2: 1, 3: 2, 4: 2}


def test_custom_groups_and_their_quality(spark):
    rows = [("p", 1, "HEAD 1", "the same text"), ("p", 2, "HEAD 2", "the same text"), ("p", 3, "OTHER", "something else")]
    df = spark.createDataFrame(rows, "page string, seq int, header string, text string")
    got = {r.seq: r.group for r in clusters.custom_groups(df, ["page"], "seq", "header", "text", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 2}
    cells = spark.createDataFrame([("p", g, k, v) for g, t in ((1, "ab"), (1, "ab"), (2, "ax")) for k, v in enumerate(t)], "page string, g int, place int, value string")
    good = clusters.consensus_quality(cells, ["page"], "g", "place", "value")
    one = clusters.consensus_quality(cells.withColumn("g", F.lit(1)), ["page"], "g", "place", "value")
    assert good.first().quality == 1.175 and one.first().quality < 1.3
    assert clusters.choose_grouping(good, one, ["page"]).first().chosen in (1, 2)


def test_rotations_split_where_copies_contradict(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 2, "b"), (2, 3, "c"), (3, 1, "a"), (3, 2, "X"), (4, 1, "a"), (4, 2, "X"), (5, 9, "z")]
    df = spark.createDataFrame([("p", c, r, t) for c, r, t in rows], "page string, copy long, row int, text string")
    assert {r.copy: r.part for r in clusters.split_rotation(df, ["page"], "copy", "row", "text").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_rotations_are_those_of_all_pairs(spark):
    draw = random.Random(7)
    rows = [(c % 3, c, r, draw.choice("ab" if c % 3 else "abcd")) for c in range(180) for r in sorted(draw.sample(range(9), draw.randint(1, 5)))]
    of, roots = {}, {}
    for p, c, r, t in rows:
        of.setdefault((p, c), {})[r] = t
        roots[c] = c

    def root(c):
        return c if roots[c] == c else root(roots[c])

    for (p, a), x in of.items():
        for (q, b), y in of.items():
            if p == q and a < b and x.keys() & y.keys() and all(x[r] == y[r] for r in x.keys() & y.keys()):
                lo, hi = sorted((root(a), root(b)))
                roots[hi] = lo
    df = spark.createDataFrame(rows, "page int, copy long, row int, text string")
    assert {r.copy: r.part for r in clusters.split_rotation(df, ["page"], "copy", "row", "text").collect()} == {c: root(c) for c in roots}


def test_rotations_of_all_orders(spark, tmp_path):
    rows = [(10, 1, "A"), (10, 1, "A"), (10, 1, "R"), (4010, 1, "A"), (4010, 2, "N"), (70_010, 2, "N"), (70_060, 2, "R"), (70_061, 2, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.copy: r.part for r in queries.G07_split_rotation(spark, str(tmp_path)).collect()}
    assert got == {10: 10, 4010: 10, 70_010: 10, 70_060: 70_060, 70_061: 70_061}


def test_snapshots(spark):
    rows = [("p", 1, 1, "a"), ("p", 1, 2, "b"), ("p", 2, 1, "a"), ("p", 2, 2, "c"), ("p", 3, 1, "a"), ("p", 4, 1, "d")]
    got = clusters.snapshots(spark.createDataFrame(rows, "page string, at int, row int, value string"), ["page"], "at", "row", "value")
    assert sorted((r.state, r.at, r.row, r.value) for r in got.collect()) == [(0, 1, 1, "a"), (0, 1, 2, "b"), (1, 2, 2, "c"), (2, 4, 1, "d")]


def test_messages_fold_over_a_gap(spark):
    rows = [("z", t, "hello") for t in (1, 2, 4, 9, 10)] + [("z", 3, "other")]
    got = clusters.fold_messages(spark.createDataFrame(rows, "zone string, at long, text string"), ["zone"], "at", "text")
    assert sorted((r.text, r.first, r.last, r.copies, r.missed) for r in got.collect()) == [("hello", 1, 4, 3, 1), ("hello", 9, 10, 2, 0), ("other", 3, 3, 1, 0)]


def test_shared_rows_fill_in(spark):
    rows = [("p", 1, 1, "common row"), ("p", 2, 1, "common rov"), ("p", 3, 2, "own"), ("p", 1, 2, "quite different"), ("q", 1, 1, "x")]
    got = clusters.shared_rows(spark.createDataFrame(rows, "page string, sub int, row int, text string"), "page", "sub", "row", "text")
    assert [(r.page, r.sub, r.row, r.text) for r in got.filter("filled").collect()] == [("p", 3, 1, "common rov")]
    assert got.filter("NOT filled").count() == len(rows)


def test_votes_with_slips_and_outliers(spark):
    base = b"THE QUICK BROWN FOX JUMPS"
    copies = [base, base, base[2:], b"xx" + base, base[:10] + b"?" + base[11:], bytes(range(25))]
    df = spark.createDataFrame([("k", i, bytearray(c)) for i, c in enumerate(copies)], "key string, seq int, data binary")
    r = clusters.vote_with_slip(df, ["key"], "seq", "data").first()
    assert bytes(r.data) == base and (r.copies, r.dropped) == (6, 1)


def test_copies_combine_around_what_was_not_read(spark):
    df = spark.createDataFrame([("f", bytearray(b"ab\0\0")), ("f", bytearray(b"\0bcd")), ("f", bytearray(b"aX\0d\0")), ("g", bytearray(b"\0\0"))], "name string, data binary")
    got = {r.name: bytes(r.data) for r in clusters.combine_copies(df, ["name"], "data", F.col("name")).collect()}
    assert got == {"f": b"abcd\0", "g": b"\0\0"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\x01\xff"), ["a", "b"], None)], "k int, d binary, l array<string>, n string")
    sinks.write_csv(df, str(tmp_path / "c"), separator=";")
    assert spark.read.option("header", True).option("sep", ";").option("escape", '"').csv(str(tmp_path / "c")).first().d == "01FF"
    sinks.write_json(df, str(tmp_path / "j"))
    assert '"n":null' in spark.read.text(str(tmp_path / "j")).first()[0]
    sinks.write_texts(df.select("k", F.lit("body").alias("t")), str(tmp_path / "t"), "t", ["k"])
    assert spark.read.text(str(tmp_path / "t")).first().value == "body"
    sinks.export_all({"one": df, "two": df}, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all" / "two")).count() == 1


def test_guides_go_out_and_come_back(spark):
    channels = spark.createDataFrame([(1, "ONE"), (2, "TWO")], "id long, name string")
    programs = spark.createDataFrame([(7, "News")], "id long, title string")
    listings = spark.createDataFrame([(1, 100, 30, 7), (1, 130, 5, 7)], "channel long, start long, minutes long, program long")
    a, b, c = sinks.read_guide(sinks.guide_json(channels, programs, listings))
    assert sorted(map(tuple, a.collect())) == [(1, "ONE"), (2, "TWO")] and tuple(b.first()) == (7, "News")
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, listings.collect()))


def test_names_from_text(spark):
    df = spark.createDataFrame([("12 Some name # note",), ("# 3 no",), ("x",), ("12   Better",), ("4 A",)], "value string").coalesce(1)
    assert {r.id: r.name for r in sinks.names_from_text(df).collect()} == {12: "Better", 4: "A"}
