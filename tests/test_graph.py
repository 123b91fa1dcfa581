"""Connected components."""

import random

from concord.operators import graph


def united(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(50)] + [(None, 4), (8, 8)]
    label = united(400, [(a, b) for a, b in links if a is not None])
    least = {}
    for i, x in enumerate(label):
        least[x] = min(least.get(x, i), i)
    want = {i: least[x] for i, x in enumerate(label) if least[x] != i}
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
