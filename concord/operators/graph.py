"""Connected components by alternating large-star and small-star steps, all on executors.

Each step rewires every node's links to the least node it sees, so links become stars whose centre is the least node of the
component, after a number of rounds that grows with the logarithm of the nodes. A hot node is pre-aggregated (a minimum) before
the shuffle, and the joins have a unique side read from a table, so that Spark can split a hot key. Every step ends in a table in
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.plans.work import cut_small, drop


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v with u > v. One star step."""
    seen = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = cut_small(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    new = seen.join(least, "u")
    if large:
        new = new.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = new.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = cut_small(new.filter("u > v").distinct(), "links")
    drop(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of links (columns a, b), roots left out. Self-links and nulls don't count."""
    ends = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = cut_small(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        for large in (True, False):
            new = _step(now, large)
            drop(now)
            now = new
        # The links are done when a round leaves them as they were: every node linked to its root only.
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or row.n == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (row.n, row.h)
