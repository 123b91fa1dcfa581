"""Host reputation, language ID, top-k search, context-tree weighting and the pipeline."""

import math
import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import ball_tree, context_tree, crf_language, queries, url_reputation
from tests.llm import util
from tests.llm.test_dedup import noisy

# --- URLs


def test_urls_and_rules(spark):
    rows = [
        (1, "HTTP://WWW.Example.com/en/x?y", ("www.example.com", "/en/x", "www.example.com/en/")),
        (2, "https://a.example.com/en/", ("a.example.com", "/en/", "example.com/en/")),
        (3, "https://example.com#/en/", ("example.com", "", None)),
        (4, "https://badexample.com/en/", ("badexample.com", "/en/", "com/")),
        (5, "ftp://x.net/fr/://y", ("x.net", "/fr/://y", "net/fr/")),
        (6, "no scheme", ("", "", None)),
        (7, None, ("", "", None)),
        (8, "a://b?c://d/", ("b", "", None)),
        (9, "x://ÉCOLE.net/es", ("École.net".replace("É", "É").lower().replace("é", "É"), "/es", None)),
        (7, "http://com/", ("com", "/", "com/")),
    ]
    pages = spark.createDataFrame([(k, u, "clash", 3) for k, u, _ in rows], "page_id long, url string, host string, low int")
    outcomes = spark.createDataFrame([], "url string, bad int")
    found = url_reputation.judge_urls(pages, outcomes, queries.URL_RULES).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule)) for r in found) == sorted((k, *want[:2], str(want[2])) for k, _, want in rows)
    verdicts = dict(queries.URL_RULES)
    assert all(r.verdict == (verdicts[r.rule] if r.rule else "block" if r.low > 0.25 else "allow") for r in found)


def test_reputation_shrinks_to_the_domain(spark):
    rng = random.Random(1)
    hosts = [(f"h{i}.good.org", 0.02) for i in range(20)] + [(f"h{i}.bad.net", 0.9) for i in range(20)]
    labelled = [(f"http://{h}/{j}", int(rng.random() < p)) for h, p in hosts for j in range(15)]
    labelled += [("http://h0.good.org/x", None), ("http://h0.good.org/x", 0)]
    pages = [(i, u) for i, (u, _) in enumerate(labelled)] + [(9001, "http://new.bad.net/"), (9002, "http://new.good.org/"), (9003, "http://other.example/")]
    found = {r.page_id: r for r in url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad int")).collect()}
    assert len(found) == len(pages)
    assert found[9001].verdict == "block" and found[9002].verdict == "allow"
    assert found[9001].host_n == 0 and found[9001].bad_rate > 0.6 > found[9003].bad_rate > found[9002].bad_rate
    assert found[0].low < found[0].bad_rate < found[0].high


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "x.y.com", "com", "", "x.y.com:8080", "me:pw@x.y.com.", "10.0.0.1", "10.0.0.1:80", "[::1]:80", "a.b.c.kobe.jp"]
    h = F.col("h")
    row = spark.createDataFrame([(x,) for x in hosts], "h string").select(url_reputation.domain_of(h), url_reputation.suffix_of(h), url_reputation.domain_of(h, ["c.kobe.jp", "kobe.jp"])).collect()
    found = dict(zip(hosts, map(tuple, row), strict=True))
    assert [found[x][:2] for x in hosts[:5]] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]
    assert found["x.y.com:8080"][:2] == found["me:pw@x.y.com."][:2] == ("y.com", "com")
    assert found["10.0.0.1"][:2] == found["10.0.0.1:80"][:2] == ("10.0.0.1", url_reputation.ADDRESS)
    assert found["[::1]:80"][:2] == ("[::1]", url_reputation.ADDRESS) and found["a.b.c.kobe.jp"][2] == "b.c.kobe.jp"


def test_the_bound_is_a_quantile(spark):
    """Against the share of a beta distribution below the bound, summed up over fine steps."""
    rows = [(f"h{i}", int(j < k)) for i, (k, n) in enumerate([(0, 3), (1, 6), (5, 12), (30, 40)]) for j in range(n)]
    data = spark.createDataFrame(rows, "host string, bad int")
    assert all(0 <= r.low <= r.bad_rate <= r.high <= 1 for r in url_reputation.host_reputation(data, data).collect())
    x = (np.arange(200_000) + 0.5) / 200_000
    for a, b, most in ((1.5, 8.0, 0.045), (4.0, 9.0, 0.02), (40.0, 20.0, 0.005)):
        mean, sd = a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        low = mean + sd * (-1.645 + (1.645**2 - 1) * 2 * (b - a) * math.sqrt(a + b + 1) / ((a + b + 2) * math.sqrt(a * b)) / 6)
        density = x ** (a - 1) * (1 - x) ** (b - 1)
        assert abs(density[x < low].sum() / density.sum() - 0.05) < most


def test_pages_of_addresses_are_labelled_by_their_path(spark, tmp_path):
    spark.createDataFrame([(1, "http://10.0.0.1/en/7", "x"), (2, "http://a.com/12x/3/", "x"), (3, "http://a.com:81/?p=/5", "x"), (4, None, "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, 1, 0), (3, 0, 0), (5, 1, 1), (12, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, queries.page_outcomes(spark, str(tmp_path)).collect())) == [("http://10.0.0.1/en/7", 0), ("http://a.com/12x/3/", 1)]


# --- language


SYLLABLES = {"aa": "ba da ga ma na".split(), "bb": "il ol ul el yl".split(), "cc": "kst prz chw dgr szk".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.randint(3, 80)), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1001, None, "aa"), (1002, "123 --- 7", "aa"), (1003, "", None), (1004, sentence(rng, "bb", 30), None), (None, sentence(rng, "cc", 9), "cc"), (1005, sentence(rng, "aa", 3000), "aa")]
    docs = spark.createDataFrame([(*r, "x", 0.1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = {r.doc_id: r for r in crf_language.identify(docs).collect()}
    assert len(found) == len(rows)
    for d, _, lang in rows[:400]:
        assert found[d].held_out == (util.part(d, 4) == 2) and 0 <= found[d].score <= 1
    held = [(d, lang) for d, _, lang in rows[:400] if found[d].held_out]
    assert sum(found[d].lang_pred == lang for d, lang in held) >= 0.98 * len(held)
    assert [(found[k].lang_pred, found[k].score) for k in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert found[1004].lang_pred == "bb" and found[1005].lang_pred == "aa" and found[None].lang_pred == "cc" and not found[None].held_out
    assert crf_language.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in crf_language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_the_sample_does_not_depend_on_partitions(spark, monkeypatch):
    """Two layouts of the same rows, with copies, give one model; of many languages, each is learnt."""
    rng = random.Random(11)
    monkeypatch.setattr(crf_language, "PER_LANGUAGE", 20)
    texts = [(sentence(rng, lang, 30), lang) for _ in range(60) for lang in SYLLABLES] + [("ba da ga ma na", "aa")] * 200
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    one = crf_language.excerpts(docs.repartition(1), F.lit(True), "doc_id", "text", "lang")
    assert one == crf_language.excerpts(docs.repartition(7, "text"), F.lit(True), "doc_id", "text", "lang")
    assert len(one) == 60 == len(set(one)) and [lang for _, lang in one] == sorted(lang for _, lang in one)


def test_eighty_languages_are_learnt(spark):
    rng = random.Random(12)
    names = [f"l{k:02d}" for k in range(80)]
    own = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choices(own[x], k=25)), x) for i, x in enumerate(names * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = crf_language.learn(docs)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert model.languages == names
    best, _ = model.predict(pa.array([t for _, t, _ in rows[:320]]))
    assert sum(names[b] == x for b, (_, _, x) in zip(best, rows, strict=False)) >= 310


def test_all_words_of_all_texts_are_learnt_from(spark, monkeypatch):
    """The words that tell two languages apart stand once, deep inside long texts; any layout and copies give the same model."""
    long = "mm " * 20_000
    texts = [(long + "kstprz " * 30 + long, "aa"), (long + "ilolul " * 30 + long, "bb")]
    docs = spark.createDataFrame([(k, *texts[k % 2]) for k in (1, 4, 5)], "doc_id long, text string, lang string")
    train = F.col("doc_id").isNotNull()
    model = crf_language.fit_all(docs.repartition(1), train, "text", "lang")
    best, score = model.predict(pa.array(["kstprz kstprz", "ilolul ilolul"]))
    assert [model.languages[b] for b in best] == ["aa", "bb"] and min(score) > 0.6
    monkeypatch.setattr(crf_language, "SHARD", 2000)
    rng = random.Random(13)
    small = [(sentence(rng, lang, 30), lang) for _ in range(20) for lang in SYLLABLES]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(small)], "doc_id long, text string, lang string")
    one, other = (crf_language.fit_all(d, train, "text", "lang") for d in (docs.repartition(1), docs.repartition(5, "text")))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.step, other.step)
    best, _ = one.predict(pa.array([sentence(rng, lang, 20) for lang in SYLLABLES]))
    assert [one.languages[b] for b in best] == list(SYLLABLES)


def test_a_shard_is_learnt_in_little_memory():
    """A learner takes few bytes for each byte of text, however many words are distinct and however long they are; groups of texts don't matter."""
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    short = [" ".join("".join(rng.choices(letters[:16], k=5)) for _ in range(700)).encode() for _ in range(1000)]
    long = [" ".join("".join(rng.choices(letters, k=2000)) for _ in range(10)).encode() for _ in range(200)]
    for texts in (short, long):
        field = crf_language.Learner(["aa", "bb"], 1)
        size = sum(map(len, texts))
        tracemalloc.start()
        field.learn(texts, [i % 2 for i in range(len(texts))])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100 * 2**20 + 16 * size, (most, size)


def test_groups_of_texts_make_the_same_field(monkeypatch):
    rng = random.Random(15)
    texts, of = [sentence(rng, lang, rng.randint(0, 40)).encode() for _ in range(40) for lang in SYLLABLES], [0, 1, 2] * 40
    fields = []
    for group in (1 << 18, 100):
        monkeypatch.setattr(crf_language, "GROUP", group)
        fields.append(crf_language.Learner(list(SYLLABLES), 1))
        fields[-1].learn(texts, of)
    assert np.array_equal(fields[0].weights, fields[1].weights) and np.array_equal(fields[0].step, fields[1].step)
    monkeypatch.setattr(crf_language, "FEATURES", 50)
    fields.append(crf_language.Learner(list(SYLLABLES), 1))
    fields[-1].learn(texts, of)
    assert np.allclose(fields[0].weights, fields[2].weights, atol=1e-3)
    for text in (b"ab cd\nef\tgh " * 9, b"x" * 50, b"x" * 33 + b" yy" * 20, b""):
        parts = list(crf_language.cuts(text, 7, 20))
        assert b"".join(parts) == text and max(map(len, parts)) <= 20
        assert all(len(p) == 20 or p[-1:].isspace() for p in parts[:-1])


def test_the_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    n, length, k = 3, 4, 3
    scores, y, start, step = rng.normal(size=(n, length, k)), rng.integers(0, k, (n, length)), rng.normal(size=k), rng.normal(size=(k, k))

    def likelihood(scores, step):
        total = 0.0
        for s, labels in zip(scores, y, strict=True):
            def value(path):
                return start[path[0]] + sum(s[t, path[t]] for t in range(length)) + sum(step[path[t], path[t + 1]] for t in range(length - 1))

            total += value(labels) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(k), repeat=length)))
        return total

    gap, pairs = crf_language.gradient(np.exp(scores), y, np.exp(start), np.exp(step))
    for at in [(0, 0, 1), (1, 2, 0), (2, 3, 2)]:
        d = np.zeros_like(scores)
        d[at] = 1e-5
        assert abs((likelihood(scores + d, step) - likelihood(scores - d, step)) / 2e-5 - gap[at]) < 1e-6
    for at in [(0, 0), (1, 2)]:
        d = np.zeros_like(step)
        d[at] = 1e-5
        assert abs((likelihood(scores, step + d) - likelihood(scores, step - d)) / 2e-5 - pairs[at]) < 1e-6


def test_words_of_switched_text_are_told_apart():
    rng = random.Random(3)
    model = crf_language.fit([(sentence(rng, lang, 40), lang) for lang in SYLLABLES for _ in range(40)])
    text = " ".join([sentence(rng, "aa", 20), sentence(rng, "cc", 20), sentence(rng, "bb", 20)])
    share, first, lettered = model.marginals(pa.array([text]))
    assert first.tolist() == [0, 60] and lettered.all()
    assert (share.argmax(axis=1) == np.repeat([0, 2, 1], 20)).mean() > 0.95
    assert np.allclose(share.sum(axis=1), 1, atol=1e-4)


def test_chunks_make_the_same_chain(monkeypatch):
    rng = np.random.default_rng(4)
    pot, first = rng.random((700, 3)).astype(np.float32) + 0.01, np.array([0, 0, 300, 301, 640, 640, 700])
    start, step = rng.random(3), rng.random((3, 3)) + 0.05
    whole = crf_language.forward_backward(pot, first, start, step)
    monkeypatch.setattr(crf_language, "CHUNK", 16)
    assert np.allclose(whole, crf_language.forward_backward(pot, first, start, step), atol=1e-4)
    # And the plain recursions of one chain.
    p = pot[301:640].astype(float)
    a, b = [start * p[0]], [np.ones(3)]
    for x in p[1:]:
        a.append((a[-1] @ step) * x)
        a[-1] /= a[-1].sum()
    for x in p[:0:-1]:
        b.append(step @ (x * b[-1]))
        b[-1] /= b[-1].sum()
    both = np.array(a) * np.array(b[::-1])
    assert np.allclose(both / both.sum(axis=1, keepdims=True), whole[301:640], atol=1e-4)


# --- search


def nearest(rows, k):
    good = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in good:
        if v % 50 == 0:
            every = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), w) for j, w, x in good if j != i and len(x) == len(q))
            out += [(v, r + 1, w, -s) for r, (s, w) in enumerate(every[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 1e7])
def test_top_k(spark, spread):
    rng = random.Random(5)
    centres = [[rng.uniform(-spread, spread) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(400, list(rows[3][1])), (401, list(rows[3][1])), (100, list(rows[7][1])), (450, None), (500, [1.0, None] * 3), (550, [math.inf] * 6), (600, [math.nan] * 6), (650, [0.5, 0.5]), (651, [0.1, 0.2]), (None, [0.0] * 6), (700, [1.0]), (750, []), (800, [])]
    data = spark.createDataFrame([(v, e, 1, 2) for v, e in rows], "vec_id long, embedding array<double>, rank int, score int")
    found = ball_tree.top_k(data, F.col("vec_id") % 50 == 0, shard=40, block=3)
    assert sorted(map(tuple, found.collect())) == nearest(rows, 5)
    assert ball_tree.top_k(data.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_scores_past_floats_are_exact(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9 + 1, -5.0]), (2, [1e9, 1.0]), (3, [-1e9, 1.0])]
    found = ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == nearest(rows, 5)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c * 300, 20, (300, 8)) for c in range(-3, 4)]).astype(np.int64)
    tree = ball_tree.BallTree.build(x, np.arange(len(x)), np.arange(len(x)))
    looked = Counter()
    real = tree.look

    def look(node, some, *rest):
        looked[node] += len(some)
        real(node, some, *rest)

    tree.look = look
    q = x[::60]
    score, ids, found = tree.search(q, np.full(len(q), -1), np.full(len(q), ball_tree.LEAST), 5)
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :5]
    assert found.all() and np.array_equal(score, want)
    leaves = (tree.left < 0).sum()
    assert sum(looked.values()) < 0.5 * leaves * len(q)


def test_a_shard_of_equal_vectors_is_cheap():
    x = np.tile(np.arange(64), (8192, 1))
    tracemalloc.start()
    tree = ball_tree.BallTree.build(x, np.arange(8192), np.arange(8192)[::-1].copy(), 6)
    q = np.tile(np.arange(64), (4096, 1))
    score, ids, found = tree.search(q, np.arange(4096) + 8192 - 4096, np.full(4096, ball_tree.LEAST), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.all() and peak < 100 << 20
    # Rows 8188 to 8191 have ids 3 to 0 and are queries, too.
    assert ids[0].tolist() == [0, 1, 2, 3, 4] and ids[4095].tolist() == [1, 2, 3, 4, 5] and ids[4094].tolist() == [0, 2, 3, 4, 5]


def test_shards_are_left_out(spark):
    """Far clusters, one of them a third of all rows: most shards are never asked, and results are those of brute force."""
    rng = random.Random(15)
    centres = [[3.0 * math.cos(a), 3.0 * math.sin(a), 0.1] for a in np.arange(12) * math.pi / 6]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[0 if i % 3 == 0 else rng.randrange(12)]]) for i in range(600)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(200)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    report = {}
    found = ball_tree.top_k(data, F.col("vec_id") % 50 == 0, shard=20, block=7, report=report)
    assert sorted(map(tuple, found.collect())) == nearest(rows, 5)
    assert report["asked"] < 0.5 * report["shards"] * report["queries"], report


# --- language model


def weighted_tree(train, depth):
    """Log probabilities by the definition of context-tree weighting: a function of the bytes before, and a byte."""
    counts, children = {}, {}
    for text in train:
        padded = b"\0" * depth + text
        for i in range(len(text)):
            for d in range(depth + 1):
                context = padded[i + depth - d : i + depth]
                for size in range(8):
                    at = (context, size, text[i] >> (8 - size))
                    counts.setdefault(at, [0, 0])[text[i] >> (7 - size) & 1] += 1
                    if d < depth:
                        children.setdefault(at, set()).add((padded[i + depth - d - 1 : i + depth], size, text[i] >> (8 - size)))
    logs = {}

    def own(at):
        z, o = counts.get(at, (0, 0))
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    def below(at):
        return sum(weighted(x) for x in children[at])

    def weighted(at):
        if at not in logs:
            logs[at] = own(at) if len(at[0]) == depth else np.logaddexp(own(at), below(at)) - math.log(2)
        return logs[at]

    def one(history, size, prefix, k=0):
        at = (history[len(history) - k :], size, prefix)
        z, o = counts.get(at, (0, 0))
        estimate = (o + 0.5) / (z + o + 1)
        if k == depth or (history[len(history) - k - 1 :], size, prefix) not in counts:
            return estimate
        w = 1 / (1 + math.exp(max(-700, min(700, below(at) - own(at)))))
        return w * estimate + (1 - w) * one(history, size, prefix, k + 1)

    def log10(history, byte):
        ones = [one(history, size, byte >> (8 - size)) for size in range(8)]
        return sum(math.log10(p if byte >> (7 - size) & 1 else 1 - p) for size, p in enumerate(ones))

    return log10


@pytest.mark.parametrize(("depth", "frequent"), [(5, 1 << 20), (5, 40), (3, 1 << 20), (2, 10)])
def test_scores_match_the_definition(spark, depth, frequent):
    """Whole scores, known and held-out texts, by a direct recursion over all training texts."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcAB é\n") for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "abracadabra abra cadabra", "abracadabra", "zzz\0z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.score for r in context_tree.score(docs, depth=depth, frequent=frequent, common=3).collect()}
    ended = [util.lower(t).encode() + b"\xff" for t in texts]
    log10 = weighted_tree([t for i, t in enumerate(ended) if util.part(i, 7) != 2], depth)
    for i, t in enumerate(ended):
        padded = b"\0" * depth + t
        assert abs(found[i] - sum(log10(padded[k : k + depth], t[k]) for k in range(len(t)))) < 1e-4, texts[i]
    assert abs(sum(10 ** log10(b"\0" * (depth - 1) + b"a", x) for x in range(256)) - 1) < 1e-9


def test_known_keys_are_found():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    table = context_tree.Known(keys, np.arange(len(keys)))
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (context_tree.Known(keys[:0], keys[:0]).find(keys) == -1).all()


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


@pytest.mark.parametrize("common", [4, 1 << 19])
def test_scores_and_base_line(spark, common):
    texts = noisy(11, 80)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same id"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 1.5, "x") for d, t in rows], "doc_id long, text string, score double, rest string")
    found = context_tree.score(docs, common=common, frequent=500).collect()
    train = [t for d, t in rows if d is not None and util.part(d, 7) != 2]
    c = Counter(w for t in train for w in util.words(util.lower(t)))
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    want = []
    for d, t in rows:
        w = util.words(util.lower(t))
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((d if d is not None else -1, d is not None and util.part(d, 7) == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(want)
    held = [r for r in found if r.held_out and r.bits_per_byte is not None and r.n_tokens > 20]
    assert held and np.mean([r.bits_per_byte for r in held]) < 5
    assert all(r.score <= 0 for r in found) and len({r.score for r in found if r.bits_per_byte is None}) == 1
    assert context_tree.score(docs.limit(0)).collect() == []
    blind = context_tree.score(docs.filter("doc_id IS NULL")).first()
    assert (blind.train_tokens, blind.n_known, blind.base_score) == (0, 0, 0.0) and abs(blind.score + 8 * math.log10(2) * (len(b"no id") + 1)) < 1e-4


def test_numbers_in_sums_survive_merging(monkeypatch):
    monkeypatch.setattr(context_tree, "HELD", 10)
    sums, want = context_tree.Sums(), Counter()
    rng = np.random.default_rng(7)
    for _ in range(20):
        keys = rng.integers(0, 30, 50)
        sums.add(keys)
        want.update(keys.tolist())
    assert dict(zip(*(x.tolist() for x in sums.take()), strict=True)) == dict(want)


# --- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    shared = sentence(rng, "aa", 45)
    item = sentence(rng, "bb", 14)
    rows = [(i, sentence(rng, lang, rng.randint(20, 60)), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(500, rows[5][1], rows[5][2]), (501, rows[6][1] + " more", rows[6][2]), (502, f"{sentence(rng, 'aa', 30)} {shared} {sentence(rng, 'aa', 30)}", "aa"), (503, f"{sentence(rng, 'aa', 40)} {shared}", "aa"), (504, f"{sentence(rng, 'bb', 40)} {item} {sentence(rng, 'bb', 9)}", "bb"), (505, "12 !! 77", "aa"), (506, None, None)]
    docs = spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    now, texts, columns = docs, dict((d, t) for d, t, _ in rows), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path)).cache()
        got = {r.doc_id: r for r in now.collect()}
        if k < 4:
            assert now.columns == columns
        if k == 0:
            assert set(texts) - set(got) == {505, 506}
        elif k == 1:
            alive = [(d, texts[d]) for d in sorted(before)]
            assert set(got) == {d for d, _, _, kept in util.near_duplicates(alive, 5) if kept} and 500 not in got
        elif k == 2:
            order = sorted(before)
            for d, (n, gone, kept) in zip(order, util.repeats([before[d].text for d in order], 35), strict=True):
                assert got[d].text == (kept if gone else before[d].text) and got[d].n_chars == len(got[d].text)
            assert shared not in got[502].text and shared not in got[503].text
        elif k == 3:
            order = sorted(before)
            assert set(got) == {d for d, x in zip(order, util.leaks([before[d].text for d in order], [(1, item), (2, "x y")], 10), strict=True) if not x[1]} and 504 not in got
        else:
            assert set(got) == set(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
        before = got
    again = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {d: r.ids for d, r in before.items()}


# --- the session


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_leave_settings_alone(spark, name):
    settings = lambda: {k: v for k, v in spark.conf.getAll.items() if k != "spark.checkpoint.dir"}
    before = settings()
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert settings() == before
