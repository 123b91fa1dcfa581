"""The reconciliation operators as queries over the tables of a folder, each with SQL for DuckDB written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.functions import columns as K
from concord.operators import clusters, graph, recovery, relations, services, similarity, streams, timeline, votes
from concord.plans.work import own_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str = "ts"):
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


#: Seconds in DuckDB.
AT = "CAST(floor(epoch(ts)) AS bigint)"

# --- votes


@query("""
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY ALL),
r AS (SELECT *, max(votes) OVER (PARTITION BY l_partkey) AS most, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_returnflag) AS rn FROM c)
SELECT l_partkey, l_returnflag, votes FROM r WHERE votes >= 3 OR (most < 3 AND rn = 1)""")
def F01_quorum_fallback(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("votes"))
    return votes.quorum(groups, ["l_partkey"], "l_returnflag", "votes", 3)


@query("""
SELECT l_partkey, l_returnflag, votes, total FROM (
  SELECT l_partkey, l_returnflag, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS bigint) AS total,
    row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE rn = 1""")
def A01_vote_smallest(spark, sf_dir):
    return votes.vote(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag")


@query("""
SELECT l_suppkey, l_returnflag, votes, total FROM (
  SELECT l_suppkey, l_returnflag, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY l_suppkey) AS bigint) AS total,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, max(l_shipdate) DESC, l_returnflag DESC) AS rn FROM lineitem GROUP BY l_suppkey, l_returnflag) WHERE rn = 1""")
def A01_vote_newest(spark, sf_dir):
    return votes.vote(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", tie="newest", order="l_shipdate")


@query("""
SELECT user_id, event_type, votes, total FROM (
  SELECT user_id, event_type, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY user_id) AS bigint) AS total,
    row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id), event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1""")
def A01_vote_first(spark, sf_dir):
    return votes.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", tie="first", order="event_id")


@query("""
SELECT l_partkey, l_linestatus, CAST(votes AS double) AS votes, CAST(total AS double) AS total FROM (
  SELECT l_partkey, l_linestatus, sum(l_quantity) AS votes, sum(sum(l_quantity)) OVER (PARTITION BY l_partkey) AS total,
    row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_linestatus) AS rn FROM lineitem GROUP BY l_partkey, l_linestatus) WHERE rn = 1""")
def A03_vote_weighted(spark, sf_dir):
    return votes.vote(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_linestatus", weight=F.col("l_quantity"))


@query("""
SELECT l_partkey, l_returnflag, votes, total FROM (
  SELECT l_partkey, l_returnflag, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS bigint) AS total,
    row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_returnflag <> 'N' THEN 0 ELSE 1 END, count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE rn = 1""")
def A04_vote_preferred(spark, sf_dir):
    return votes.vote(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", prefer=F.col("l_returnflag") != "N")


@query("""
WITH c AS (SELECT p_brand, i AS pos, substr(p_name, i, 1) AS ch FROM part, unnest(range(1, length(p_name) + 1)) AS t(i)),
v AS (SELECT p_brand, pos, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand, pos) AS tot, row_number() OVER (PARTITION BY p_brand, pos ORDER BY count(*) DESC, ch) AS rn FROM c GROUP BY p_brand, pos, ch)
SELECT p_brand, string_agg(ch, '' ORDER BY pos) AS text, CAST(max(tot) AS bigint) AS copies FROM v WHERE rn = 1 GROUP BY p_brand""")
def A02_vote_positional(spark, sf_dir):
    return votes.positional_vote(table(spark, sf_dir, "part"), ["p_brand"], "p_name")


@query("""
SELECT user_id, event_type, total, CAST(sign(total) AS integer) AS bit FROM (
  SELECT user_id, event_type, CAST(sum(CAST(round((value - 50) * 100) AS bigint)) AS bigint) AS total FROM events GROUP BY ALL)""")
def A05_soft_vote(spark, sf_dir):
    soft = table(spark, sf_dir, "events").withColumn("soft", F.expr("CAST(round((value - 50) * 100) AS bigint)"))
    return votes.soft_vote(soft, ["user_id", "event_type"], "soft")


@query("""
SELECT l_suppkey, CAST(sum(CASE WHEN ones * 2 > n THEN 1 << b ELSE 0 END) AS bigint) AS word FROM (
  SELECT l_suppkey, b, sum((l_orderkey >> b) & 1) AS ones, count(*) AS n FROM lineitem, unnest(range(0, 16)) AS t(b) GROUP BY l_suppkey, b) GROUP BY l_suppkey""")
def A06_bit_majority(spark, sf_dir):
    return votes.bit_majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", 16)


@query("""
SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id""")
def A09_distinct_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


@query("""
SELECT l_partkey, l_returnflag, votes, total FROM (
  SELECT l_partkey, l_returnflag, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS bigint) AS total,
    row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY l_partkey, l_returnflag)
WHERE rn = 1 AND votes >= 2 AND votes * 100 >= total * 60""")
def A10_pick_60_percent(spark, sf_dir):
    return votes.pick(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag")


@query(f"""
WITH e AS (SELECT user_id, event_id AS x, {AT} AS y FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x, y) AS i, count(*) OVER (PARTITION BY user_id) AS n, max(x) OVER (PARTITION BY user_id) - min(x) OVER (PARTITION BY user_id) AS wide FROM e),
p AS (SELECT a.user_id, (b.y - a.y)::double / (b.x - a.x) AS s FROM r a JOIN r b ON a.user_id = b.user_id AND b.i = (a.i * 7919 + 104729) % a.n + 1 WHERE abs(b.x - a.x) > 0.2 * a.wide),
l AS (SELECT user_id, CASE WHEN count(*) > 10 THEN median(s) ELSE 1 END AS s FROM p GROUP BY user_id), f AS (SELECT e.*, y - coalesce(s, 1) * x AS left_over FROM e LEFT JOIN l USING (user_id)),
m AS (SELECT user_id, median(left_over) AS m FROM f GROUP BY user_id)
SELECT user_id, round(regr_slope(y, x), 4) AS slope, count(*) AS n FROM f JOIN m USING (user_id) WHERE abs(left_over - m) <= 200000 GROUP BY user_id""")
def A11_robust_fit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), seconds().alias("y"))
    return votes.robust_fit(e, ["user_id"], "x", "y", 200_000).select("user_id", F.round("slope", 4).alias("slope"), "n")


@query("""
SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY ALL""")
def A11_percentile_band(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("mid"), F.round(F.percentile("o_totalprice", F.lit(0.1)), 4).alias("p10"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS s FROM c)
SELECT user_id, round(-sum(n / s * log2(n / s)), 6) + 0 AS entropy FROM t GROUP BY user_id""")
def A12_entropy(spark, sf_dir):
    return votes.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", (F.round("entropy", 6) + 0).alias("entropy"))


@query("""
SELECT date_trunc('day', ts) AS window_start, count(*) AS received, count(*) FILTER (event_type = 'error') AS unreadable, round(avg(CASE WHEN bit_count(event_id) % 2 = 1 THEN 1.0 ELSE 0.0 END), 6) AS parity
FROM events GROUP BY 1""")
def A13_quality_by_day(spark, sf_dir):
    odd = F.when(F.bit_count("event_id") % 2 == 1, 1.0).otherwise(0.0)
    return timeline.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", received=F.count("*"), unreadable=F.count_if(F.col("event_type") == "error"), parity=F.round(F.avg(odd), 6))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), m AS (SELECT l_orderkey, CAST(max(l_linenumber) AS bigint) AS expected, count(*) AS had FROM l GROUP BY 1)
SELECT m.l_orderkey, expected, had, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM unnest(range(1, expected + 1)) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = m.l_orderkey AND l.l_linenumber = i)), '') AS missing FROM m""")
def A14_missing_blocks(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    of = have.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    found = relations.missing(have.join(of, "l_orderkey"), ["l_orderkey"], "l_linenumber", "last")
    return found.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS bigint) AS total FROM orders GROUP BY 1")
def A15_partial_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [orders.filter(F.col("o_orderkey") % 2 == k).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total")) for k in (0, 1)]
    return relations.merge_counters(parts, ["o_orderpriority"], ["n", "total"])


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(ts AS date)) AS kinds FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS rn, lead(n, 1, 0) OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS second FROM c)
SELECT user_id, event_type, n FROM r WHERE rn = 1 AND n >= 3 AND n >= second * 1 AND kinds >= 3""")
def A16_consensus(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return votes.consensus(e, ["user_id"], "event_type", "day", lead=1)


@query("""
WITH s AS (SELECT c_nationkey, c_name, regexp_replace(c_name, '[0-9]', '#', 'g') AS shape FROM customer),
a AS (SELECT c_nationkey, shape, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, shape) AS rn FROM s GROUP BY c_nationkey, shape),
b AS (SELECT c_nationkey, c_name, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_name) AS rn FROM s JOIN (SELECT c_nationkey, shape FROM a WHERE rn = 1) USING (c_nationkey, shape) GROUP BY c_nationkey, c_name)
SELECT c_nationkey, c_name, n FROM b WHERE rn = 1""")
def A17_header_shape(spark, sf_dir):
    return votes.header_shape(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_name")


@query("""
WITH w AS (SELECT DISTINCT conv_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM conversations)
SELECT word, count(DISTINCT conv_id) AS pages FROM w WHERE word <> '' GROUP BY word HAVING count(DISTINCT conv_id) * 100 >= (SELECT count(DISTINCT conv_id) FROM conversations) * 20""")
def A18_common_words(spark, sf_dir):
    return votes.common_words(table(spark, sf_dir, "conversations"), "conv_id", "text", percent=20)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM c) WHERE n >= 3 AND n * 10 >= top""")
def F06_rare_filter(spark, sf_dir):
    return votes.rare_filter(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
WITH r AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT source, line, count(*) AS n, count(DISTINCT lang) AS own FROM r WHERE line <> '' GROUP BY ALL)
SELECT source, sha256(line) AS line, n FROM (SELECT *, max(n) OVER (PARTITION BY line) AS top FROM c) WHERE n * 3 > top OR own >= 2""")
def F09_foreign_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return votes.foreign_rows(rows, "source", "line", "lang").withColumn("line", F.sha2(F.col("line").cast("binary"), 256))


@query("""
WITH k AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1)
SELECT user_id, event_type, event_id FROM events JOIN k USING (user_id, event_type)""")
def F05_kind_majority(spark, sf_dir):
    return votes.majority_kind(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_discount BETWEEN 0.01 AND 0.09 AND l_shipdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31'")
def F02_plausible(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_quantity").between(5, 45) & F.col("l_discount").between(0.01, 0.09) & F.expr("l_shipdate BETWEEN TIMESTAMP_NTZ'1993-01-01' AND TIMESTAMP_NTZ'1997-12-31'")).select("l_orderkey", "l_linenumber")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) >= 12) AS informative FROM l GROUP BY doc_id""")
def F03_informative_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.length(F.regexp_replace("line", r"\s", "")) >= 12).alias("informative"))


@query("""
SELECT doc_id, letters * 100 // n AS letter_share, words FROM (
  SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents WHERE length(text) > 0) WHERE letters * 2 >= n""")
def F04_text_likeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    d = d.select("doc_id", F.length("text").alias("n"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"), F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).cast("long").alias("words"))
    return d.filter("letters * 2 >= n").select("doc_id", F.expr("CAST(letters * 100 div n AS bigint)").alias("letter_share"), "words")


@query("SELECT p_partkey, p_name FROM part WHERE contains(CAST(p_partkey AS varchar), '17') OR contains(lower(p_name), 'ar') ORDER BY p_name, p_partkey")
def F07_user_filter_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_partkey").cast("string").contains("17") | F.lower("p_name").contains("ar")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("""
WITH m AS (SELECT source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS share FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) JOIN m USING (source) WHERE share < 0.8 OR quality = 1""")
def F08_integrity_filter(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    share = both.groupBy("source").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("share"))
    return both.join(share, "source").filter("share < 0.8 OR quality = 1").select("doc_id", "source", "quality")


@query("SELECT source, median(n) < 60 AS sparse, CAST(sum(n) AS bigint) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def F10_sparse_streams(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg((F.median("n") < 60).alias("sparse"), F.sum("n").alias("n"))


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.quality, b.v) AS quality
FROM (SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL) a FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS v FROM documents) b ON a.doc_id = b.doc_id""")
def F11_unverified_fill(spark, sf_dir):
    a = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", "quality")
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("v"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("quality", "v").alias("quality"))


@query("""
WITH v AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS judged, count(*) FILTER (lineitem.l_returnflag = v.l_returnflag) AS same FROM lineitem JOIN v ON v.l_suppkey = lineitem.l_suppkey AND rn = 1 GROUP BY l_orderkey
HAVING count(*) >= 4 AND count(*) FILTER (lineitem.l_returnflag = v.l_returnflag) * 2 < count(*)""")
def F12_outliers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    voted = votes.vote(li, ["l_suppkey"], "l_returnflag").select("l_suppkey", F.col("l_returnflag").alias("voted"))
    by = li.join(voted, "l_suppkey").groupBy("l_orderkey").agg(F.count("*").alias("judged"), F.count_if(F.col("l_returnflag") == F.col("voted")).alias("same"))
    return by.filter("judged >= 4 AND same * 2 < judged")


# --- time


@query("""
SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 10 AS gap FROM events) WHERE gap <> 0""")
def W01_lag_breaks(spark, sf_dir):
    return timeline.breaks(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_id", 10).select("user_id", "event_id", "gap")


@query(f"""
WITH e AS (SELECT user_id, event_type, event_id, {AT} AS t FROM events),
f AS (SELECT *, CASE WHEN t - lag(t) OVER w BETWEEN 1 AND 90000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, event_type, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY user_id, event_type, island HAVING count(*) >= 2""")
def W02_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", seconds().alias("t"))
    found = timeline.islands(e, ["user_id", "event_type"], ["t", "event_id"], F.col("t"), 1, 90_000)
    return found.groupBy("user_id", "event_type", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).filter("n >= 2").drop("island")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM events)
SELECT user_id, event_id, coalesce(kind, CASE WHEN lag(kind) OVER w = lead(kind) OVER w AND event_id - lag(event_id) OVER w < 400 AND lead(event_id) OVER w - event_id < 400 THEN lag(kind) OVER w END) AS repaired
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def W03_neighbour_repair(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return timeline.repair_from_neighbours(e, ["user_id"], "event_id", "kind", 400).select("user_id", "event_id", "repaired")


@query("""
SELECT l_orderkey, l_linenumber, gap FROM (
  SELECT l_orderkey, l_linenumber, (((l_linenumber % 4) - (lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) % 4) - 1) % 4 + 4) % 4 AS gap FROM lineitem) WHERE gap <> 0""")
def W04_continuity_gaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("ci", F.col("l_linenumber") % 4)
    return timeline.breaks(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], "ci", 1, 4).select("l_orderkey", "l_linenumber", "gap")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")
def W05_collapse_repeats(spark, sf_dir):
    return timeline.collapse(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def W06_first_per_key(spark, sf_dir):
    return timeline.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations")
def W07_next_row(spark, sf_dir):
    return timeline.next_row(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


@query("""
WITH s AS (SELECT o_custkey, CAST(floor(epoch(o_orderdate) / 86400) AS bigint) AS s, CAST(floor(epoch(o_orderdate) / 86400) AS bigint) + 30 AS e, o_orderkey, o_orderstatus = 'P' AS d FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, s ORDER BY d, o_orderkey) AS rn FROM s)
SELECT o_custkey, o_orderkey, s, least(e, lead(s) OVER (PARTITION BY o_custkey ORDER BY s)) AS e FROM r WHERE rn = 1""")
def W08_overlap_resolve(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) div 86400 AS bigint)").alias("s"), (F.col("o_orderstatus") == "P").alias("d"))
    found = timeline.resolve_overlaps(o.withColumn("e", F.col("s") + 30), ["o_custkey"], "s", "e", "o_orderkey", "d")
    return found.select("o_custkey", "o_orderkey", "s", F.col("end").alias("e"))


@query("""
SELECT event_type, user_id, n, rank FROM (SELECT event_type, user_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS integer) AS rank FROM events GROUP BY event_type, user_id) WHERE rank <= 3""")
def W09_top_per_key(spark, sf_dir):
    return timeline.top_per_key(table(spark, sf_dir, "events"), ["event_type"], "user_id", 3)


@query(f"""
WITH e AS (SELECT user_id, event_id, {AT} AS t FROM events)
SELECT user_id, event_id, t AS start, least(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 7) AS "end" FROM e""")
def W10_capped_end(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", seconds().alias("start"))
    return timeline.capped_ends(e, ["user_id"], ["start", "event_id"], "start", 7)


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN value > 50 THEN event_type END AS x FROM events)
SELECT user_id, event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM e""")
def W11_forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("x"))
    return timeline.forward_fill(e, ["user_id"], ["event_id"], "x").select("user_id", "event_id", "filled")


@query("""
WITH c AS (SELECT user_id, event_id, event_id % 256 AS c FROM events), f AS (SELECT *, CASE WHEN c < lag(c) OVER (PARTITION BY user_id ORDER BY event_id) THEN 256 ELSE 0 END AS fell FROM c)
SELECT user_id, event_id, c + CAST(sum(fell) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS whole FROM f""")
def W12_unwrap_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 256).alias("c"))
    return timeline.unwrap(e, ["user_id"], ["event_id"], "c", 256).select("user_id", "event_id", "whole")


@query("""
WITH s AS (SELECT user_id, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) AS l FROM events),
c AS (SELECT user_id, event_id, x, count(*) AS n FROM (SELECT user_id, event_id, unnest(l) AS x FROM s) GROUP BY ALL)
SELECT user_id, event_id, x AS voted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY n DESC, x) AS rn FROM c) WHERE rn = 1""")
def W13_rolling_vote(spark, sf_dir):
    return timeline.rolling_vote(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type", 10).select("user_id", "event_id", "voted")


@query("""
SELECT p_partkey, CAST(ntile(4) OVER w AS integer) AS quarter, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS integer) AS size_rank, nth_value(p_partkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)""")
def W14_ranks(spark, sf_dir):
    w = W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(W.partitionBy("p_brand").orderBy("p_size")).alias("size_rank"), F.nth_value("p_partkey", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("second"))


@query(f"""
WITH e AS (SELECT user_id, event_id, {AT} AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 3600 THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, CAST(session AS bigint) AS session, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY user_id, session""")
def R05_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", seconds().alias("t"))
    return timeline.sessions(e, ["user_id"], "t", F.col("t"), 3600, "event_id").groupBy("user_id", "session").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL (2 * k) DAY AS window_start, event_type FROM events, unnest(range(0, 2)) AS t(k))
SELECT window_start, event_type, votes FROM (SELECT window_start, event_type, count(*) AS votes, row_number() OVER (PARTITION BY window_start ORDER BY count(*) DESC, event_type) AS rn FROM w GROUP BY window_start, event_type) WHERE rn = 1""")
def R04_sliding_best(spark, sf_dir):
    return timeline.sliding_best(table(spark, sf_dir, "events"), "ts", "4 days", "2 days", "event_type")


@query(f"""
WITH a AS (SELECT event_id, event_type, {AT} AS t FROM events WHERE event_type <> 'click'), b AS (SELECT DISTINCT event_type, {AT} AS t FROM events WHERE event_type = 'click'),
x AS (SELECT a.event_id, a.t, b.t AS bt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS rn FROM a LEFT JOIN b ON abs(a.t - b.t) <= 600)
SELECT event_id, bt AS clock, CAST(abs(t - bt) AS bigint) AS distance FROM x WHERE rn = 1""")
def J04_nearest_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", seconds().alias("t"), F.lit(0).alias("all"))
    # The clock is cut into hours so that no task has all of it; each hour sees the clock rows within reach of it.
    reach, hour = 600, 3600
    left = e.filter("event_type <> 'click'").withColumn("hour", F.expr(f"t div {hour}"))
    clock = e.filter("event_type = 'click'").select("t").distinct().withColumn("hour", F.explode(F.expr(f"sequence((t - {reach}) div {hour}, (t + {reach}) div {hour})"))).withColumn("clock", F.col("t"))
    return timeline.nearest(left, clock, ["hour"], "t", "clock", reach).select("event_id", "clock", "distance")


@query("""
WITH p AS (SELECT event_id, CAST(floor(epoch(ts) / 60) AS bigint) AS m FROM events), s AS (SELECT o_orderkey, CAST(o_orderkey * 7 % 43200 + 28401120 AS bigint) AS a, CAST(o_orderkey * 7 % 43200 + 28401120 + 30 + o_custkey % 60 AS bigint) AS b FROM orders WHERE o_orderstatus = 'F')
SELECT event_id, o_orderkey FROM p JOIN s ON m >= a AND m < b""")
def J03_on_air_interval(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 60 AS bigint)").alias("m"))
    a = (F.col("o_orderkey") * 7 % 43200 + 28401120).cast("long")
    s = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", a.alias("a"), (a + 30 + F.col("o_custkey") % 60).cast("long").alias("b"))
    return timeline.in_interval(p, s, [], "m", "a", "b", 60).select("event_id", "o_orderkey")


# --- relations


@query("""
SELECT c_custkey, coalesce(n_name, '#' || c_nationkey) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON c_nationkey = n_nationkey""")
def J01_title_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relations.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("""
SELECT s_suppkey, coalesce(a.n_name, r_name) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) a ON s_nationkey = a.n_nationkey
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) b ON s_nationkey = b.n_nationkey""")
def J02_name_fallback(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    second = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("name"))
    return relations.fallback(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), first, second, "s_nationkey", "name").select("s_suppkey", "name")


@query("""
SELECT DISTINCT p_partkey, prefix FROM part JOIN (SELECT DISTINCT substr(p_name, 1, 4) AS prefix FROM part WHERE p_size < 5) ON starts_with(p_name, prefix)""")
def J05_prefix_match(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return relations.prefix_match(part, part.filter("p_size < 5").select(F.substring("p_name", 1, 4).alias("prefix")).distinct(), "p_name", "prefix", 4).select("p_partkey", "prefix")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def J07_anti_unplaced(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(big, "o_orderkey", "left_anti")


@query("SELECT item_id FROM benchmark b WHERE length(text) < 8 OR NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def J07_texts_not_contained(spark, sf_dir):
    return relations.not_contained(table(spark, sf_dir, "benchmark"), "text", table(spark, sf_dir, "documents"), "text", gram=24).select("item_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate = o_orderdate)")
def J08_semi_same(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("o_orderdate"))
    return table(spark, sf_dir, "orders").join(li, ["o_orderkey", "o_orderdate"], "left_semi").select("o_orderkey", "o_custkey")


@query("""
WITH l AS (SELECT c_custkey AS k, c_mktsegment AS v, CAST(c_custkey % 7 AS bigint) AS t FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT o_custkey AS k, o_orderpriority AS v2, o_orderkey AS t2 FROM orders),
j AS (SELECT coalesce(l.k, r.k) AS k, t, v, v2, t2 FROM l FULL JOIN r ON l.k = r.k)
SELECT k, t, coalesce(CASE WHEN t = 3 THEN NULL ELSE v END, arg_min(v2, struct_pack(d := abs(t - t2), e := t2))) AS v FROM j GROUP BY k, t, v""")
def J09_outer_fill(spark, sf_dir):
    left = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).alias("t"), F.when(F.col("c_custkey") % 7 != 3, F.col("c_mktsegment")).alias("v"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("t"))
    return relations.fill_from_nearest(left, right, ["k"], "v", "t").select("k", "t", "v")


@query("""
WITH o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name, c_custkey % 2 = 0 AS verified FROM customer WHERE c_custkey % 4 <> 1),
n AS (SELECT c_custkey AS id, c_mktsegment AS name, c_custkey % 3 = 0 AS verified FROM customer WHERE c_custkey % 4 <> 2)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN take THEN n.name ELSE o.name END AS name, CASE WHEN take THEN n.verified ELSE o.verified END AS verified,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' WHEN take THEN 'replaced' ELSE 'kept' END AS outcome
FROM (SELECT o, n, o.id IS NULL OR (n.id IS NOT NULL AND ((o.name = '' AND n.name <> '') OR (NOT o.verified AND n.verified))) AS take FROM o FULL JOIN n ON o.id = n.id)""")
def J10_upsert_precedence(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("name"), (F.col("c_custkey") % 2 == 0).alias("verified"))
    new = c.filter("c_custkey % 4 <> 2").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 3 == 0).alias("verified"))
    return relations.upsert(old, new, ["id"], relations.better_name())


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey % 4 AS version, o_orderkey % 3 = 0 AS verified FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS id, o_custkey % 2 AS version, o_orderkey % 2 = 0 AS verified FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN take THEN n.version ELSE o.version END AS version, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'kept' WHEN take THEN 'replaced' ELSE 'kept' END AS outcome
FROM (SELECT o, n, o.id IS NULL OR (n.id IS NOT NULL AND NOT (o.version = n.version AND (o.verified OR NOT n.verified)) AND (n.verified OR NOT o.verified)) AS take FROM o FULL JOIN n ON o.id = n.id)""")
def J10_upsert_show_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("version"), (F.col("o_orderkey") % 3 == 0).alias("verified"))
    new = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("version"), (F.col("o_orderkey") % 2 == 0).alias("verified"))
    return relations.upsert(old, new, ["id"], relations.better_list()).select("id", "version", "outcome")


@query("""
WITH k AS (SELECT DISTINCT lpad(CAST(c_custkey * 37 % 100000 AS varchar), 5, '0') AS k, c_custkey % 10 < 3 AS good FROM customer), g AS (SELECT k FROM k WHERE good), b AS (SELECT k FROM k EXCEPT SELECT k FROM g),
m AS (SELECT b.k, g.k AS t FROM b JOIN g ON len(list_filter(range(1, 6), lambda i: substr(b.k, i, 1) <> substr(g.k, i, 1))) = 1)
SELECT b.k, CASE WHEN count(m.t) = 1 THEN min(m.t) END AS folded FROM b LEFT JOIN m ON m.k = b.k GROUP BY b.k UNION ALL SELECT k, k FROM g""")
def J11_fold_one_digit(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0").alias("k"), (F.col("c_custkey") % 10 < 3).alias("good"))
    return relations.fold_one_digit(keys, "k", F.col("good"))


@query("""
WITH RECURSIVE l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey * 2 <= (SELECT max(o_orderkey) FROM orders) THEN o_orderkey * 2 END AS nx FROM orders),
c AS (SELECT k AS start, k, 0 AS step FROM l WHERE k NOT IN (SELECT nx FROM l WHERE nx IS NOT NULL) UNION ALL SELECT c.start, l.nx, step + 1 FROM c JOIN l ON c.k = l.k WHERE l.nx IS NOT NULL)
SELECT start, k, step FROM c""")
def J16_continuation_chain(spark, sf_dir):
    """From every record that no other points to."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    most = o.agg(F.max("k")).first()[0]
    l = o.withColumn("nx", F.when(F.col("k") * 2 <= most, F.col("k") * 2))  # noqa: E741
    return relations.chain(l, "k", "nx", o.join(l.select(F.col("nx").alias("k")), "k", "left_anti"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS blocks, count(l_orderkey) = 4 AS whole FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def J17_blocks_of_catalogue(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_linenumber").alias("blocks"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(have, "o_orderkey", "left").select("o_orderkey", F.coalesce("blocks", F.lit(0)).alias("blocks"), (F.coalesce("blocks", F.lit(0)) == 4).alias("whole"))


@query("""
SELECT 'customer' AS service, c_custkey AS id, c_name AS name, CAST(NULL AS double) AS price FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice FROM part""")
def U01_finds_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return relations.united([("customer", c), ("supplier", s), ("part", p)])


@query("""
WITH c AS (SELECT DISTINCT user_id, event_type AS clue, CAST(isodow(ts) AS integer) AS cand FROM events WHERE value > 97), n AS (SELECT user_id, count(DISTINCT clue) AS n FROM c GROUP BY 1),
f AS (SELECT user_id, cand FROM c JOIN n USING (user_id) GROUP BY user_id, cand, n HAVING count(DISTINCT clue) = n)
SELECT user_id, min(cand) AS cand FROM f GROUP BY user_id HAVING count(*) = 1""")
def U02_candidate_intersection(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value > 97").select("user_id", F.col("event_type").alias("clue"), (F.weekday("ts") + 1).alias("cand"))
    return relations.only_candidate(e, "user_id", "clue", "cand")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def U03_except_uncovered(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").exceptAll(table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query("SELECT event_type, min(event_id) AS seq FROM events GROUP BY event_type")
def U04_distinct_in_order(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("seq"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 24")
def T03_top_global(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(24)


@query("SELECT l_suppkey, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY l_suppkey")
def T02_groups_by_size(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first")).orderBy(F.desc("n"), "first")


@query("SELECT o_custkey, list_sort(list(CAST(round(o_totalprice) AS bigint)))[1:3]::varchar AS least FROM orders GROUP BY 1")
def T04_least_reliable(spark, sf_dir):
    least = F.slice(F.array_sort(F.collect_list(F.expr("CAST(round(o_totalprice) AS bigint)"))), 1, 3)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(least.cast("array<string>"), ", "), F.lit("]")).alias("least"))


# --- similarity


@query("""
WITH t AS (SELECT p_partkey AS k, rpad(substr(p_name, 1, 40), 40, ' ') AS t FROM part), o AS (SELECT t, min(k) AS k FROM t GROUP BY t)
SELECT a, b, distance FROM (SELECT x.k AS a, y.k AS b, CAST(hamming(x.t, y.t) AS integer) AS distance FROM o x JOIN o y ON x.k < y.k) WHERE distance <= 3""")
def J06_block_similarity(spark, sf_dir):
    return similarity.block_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("""
WITH RECURSIVE t AS (SELECT p_partkey AS k, rpad(substr(p_name, 1, 40), 40, ' ') AS t FROM part), o AS (SELECT t, min(k) AS k FROM t GROUP BY t),
e AS (SELECT x.k AS a, y.k AS b FROM o x JOIN o y ON x.k <> y.k AND hamming(x.t, y.t) <= 3),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a)
SELECT n AS node, min(m) AS root FROM r GROUP BY n HAVING min(m) <> n""")
def G05_components(spark, sf_dir):
    return graph.components(similarity.block_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name"))


@query("""
WITH c AS (SELECT lower(word) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,8}[0-9]?')) AS word FROM conversations) GROUP BY 1),
m AS (SELECT c.w, c.n, d.w AS o, d.n AS k, row_number() OVER (PARTITION BY c.w ORDER BY d.n DESC, d.w) AS rn FROM c JOIN d ON length(c.w) = length(d.w) AND d.n >= c.n * 3 AND hamming(c.w, d.w) = 1
  AND NOT regexp_matches(list_filter(range(1, length(c.w) + 1), lambda i: substr(c.w, i, 1) <> substr(d.w, i, 1)).list_transform(lambda i: substr(c.w, i, 1) || substr(d.w, i, 1))[1], '[0-9]'))
SELECT c.w, c.n, coalesce(m.o, c.w) AS merged FROM c LEFT JOIN m ON m.w = c.w AND rn = 1""".replace("FROM c JOIN d", "FROM c JOIN c d"))
def G20_near_name_merge(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,8}[0-9]?"), F.lit(0))).alias("w"))
    return similarity.merge_near_names(words, "w")


@query("""
WITH r AS (SELECT user_id % 10 AS line, event_id % 64 AS v FROM events), c AS (SELECT line, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY line) AS s FROM r GROUP BY line, v),
b AS (SELECT line, v, n FROM c WHERE n * 100 >= s * 2), x AS (SELECT c.line, c.v, b.v AS t, row_number() OVER (PARTITION BY c.line, c.v ORDER BY bit_count(xor(c.v, b.v)), b.n DESC, b.v) AS rn FROM c JOIN b ON c.line = b.line AND bit_count(xor(c.v, b.v)) <= 2)
SELECT r.line, r.v, x.t AS snapped, count(*) AS n FROM r LEFT JOIN x ON x.line = r.line AND x.v = r.v AND rn = 1 GROUP BY ALL""")
def G21_snap_ids(spark, sf_dir):
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("line"), (F.col("event_id") % 64).alias("v"))
    return similarity.snap(r, ["line"], "v", percent=2).groupBy("line", "v", "snapped").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT (conv_id * 1000 + turn) * 1000 + i // 60 AS k, substr(text, i::int + 1, 120) AS t FROM conversations, unnest(range(0, length(text), 60)) AS v(i)), p AS (SELECT a.k AS a, b.k AS b, i AS "at", least(length(a.t) - i, length(b.t)) AS overlap, substr(a.t, i + 1, least(length(a.t) - i, length(b.t))::int) AS x, substr(b.t, 1, least(length(a.t) - i, length(b.t))::int) AS y
  FROM t a, unnest(range(0, length(a.t) - 7)) AS u(i), t b WHERE a.k <> b.k AND substr(a.t, i::int + 1, 8) = substr(b.t, 1, 8)),
q AS (SELECT *, len(list_filter(range(1, overlap + 1), lambda j: substr(x, j::int, 1) <> substr(y, j::int, 1))) AS off FROM p)
SELECT a, b, CAST("at" AS integer) AS "at", CAST(overlap AS integer) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY overlap DESC, "at") AS rn FROM q WHERE off * 12 <= overlap) WHERE rn = 1""")
def J12_gram_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "conversations").filter("length(text) > 0").select("conv_id", "turn", F.posexplode(relations.stretches(F.col("text"), 60, 60)).alias("i", "t"))
    cuts = part.select(((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("i")).alias("k"), "t")
    return similarity.gram_overlaps(cuts, "k", "t")


@query("""
WITH w AS (SELECT lower(unnest(regexp_split_to_array(text, '[^\\p{L}]+'))) AS w FROM conversations), g AS (SELECT substr(' ' || w || ' ', i::int, 3) AS gram FROM w, unnest(range(1, length(w) + 1)) AS t(i) WHERE w <> '')
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def G27_trigram_counts(spark, sf_dir):
    return similarity.trigrams(table(spark, sf_dir, "conversations"), "text")


@query("""
WITH w AS (SELECT lower(unnest(regexp_split_to_array(text, '[^\\p{L}]+'))) AS w FROM conversations), g AS (SELECT substr(' ' || w || ' ', i::int, 3) AS gram FROM w, unnest(range(1, length(w) + 1)) AS t(i) WHERE w <> ''), c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram), s AS (SELECT sum(n) AS s FROM c),
p AS (SELECT DISTINCT p_name AS w FROM part WHERE length(p_name) > 0)
SELECT w, round(avg(ln((coalesce(n, 0) + 0.05) / (s + 0.05))), 6) AS score FROM (SELECT w, substr(' ' || lower(w) || ' ', i::int, 3) AS gram FROM p, unnest(range(1, length(w) + 1)) AS t(i)) x LEFT JOIN c ON c.gram = x.gram, s GROUP BY w""")
def C15_word_plausibility(spark, sf_dir):
    counts = similarity.trigrams(table(spark, sf_dir, "conversations"), "text")
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("w"))
    return similarity.plausibility(words, "w", counts).select("w", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations) GROUP BY 1), m AS (SELECT b.w, min(g.w) AS a, max(g.w) AS z FROM c b JOIN c g ON b.n < 5 AND g.n >= 5 AND g.n >= b.n * 10 AND length(b.w) = length(g.w) AND hamming(b.w, g.w) = 1 GROUP BY b.w)
SELECT c.w, c.n, CASE WHEN m.a = m.z THEN m.a ELSE c.w END AS restored FROM c LEFT JOIN m ON m.w = c.w""")
def G27_restore_words(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w"))
    return similarity.restore_words(words, "w")


@query("""
SELECT user_id, event_type, event_id AS best, copies FROM (SELECT user_id, event_type, event_id, value > 50 AS ok, length(props) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS copies, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value > 50 DESC, length(props) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def G24_best_copy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return relations.best_copy(e, ["user_id", "event_type"], [F.col("value") > 50, F.length("props")], ["event_id"]).withColumnRenamed("event_id", "best")


# --- codes and packets: values are encoded, damaged as far as the code can mend, decoded, and must be what they were

#: A digest of whole texts, as DuckDB sees them.
PAYLOAD = "SELECT doc_id, sha256(regexp_replace(text, '[^ -~]', '', 'g')) AS payload FROM documents WHERE length(regexp_replace(text, '[^ -~]', '', 'g')) > 0"


#: Whole texts go to Python few at a time, as a worker holds a batch several times over.
SHORT = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def _round_trip(spark: SparkSession, sf_dir: str, kind: str, bent: bool = True) -> DataFrame:
    """Whole texts there and back: a digest of what came back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t")).filter("length(t) > 0")
    d = own_session(d, SHORT)
    d = d.withColumn("size", F.length("t")).withColumn("sent", K.encode_bytes(F.col("t").cast("binary"), kind))
    if bent:
        d = d.withColumn("sent", K.damage(F.col("sent"), F.col("doc_id"), kind))
    return d.select("doc_id", F.sha2(K.decode_bytes(F.col("sent"), F.col("size"), kind), 256).alias("payload"))


@query(PAYLOAD)
def E01_rt_hamming84(spark, sf_dir):
    return _round_trip(spark, sf_dir, "hamming84")


@query(PAYLOAD)
def E02_rt_hamming2418(spark, sf_dir):
    return _round_trip(spark, sf_dir, "hamming2418")


@query(PAYLOAD)
def E03_rt_hamming74(spark, sf_dir):
    return _round_trip(spark, sf_dir, "hamming74")


@query(PAYLOAD)
def E04_rt_parity(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parity", bent=False)


@query(PAYLOAD)
def E12_rt_difference_set(spark, sf_dir):
    return _round_trip(spark, sf_dir, "difference_set")


@query(PAYLOAD)
def E13_rt_product_code(spark, sf_dir):
    return _round_trip(spark, sf_dir, "product")


@query(PAYLOAD)
def E15_rt_bch(spark, sf_dir):
    return _round_trip(spark, sf_dir, "bch")


@query("SELECT p_partkey, true AS arc_ok, true AS open_ok, true AS kermit_ok FROM part")
def E07_crc_residues(spark, sf_dir):
    """A message followed by its own CRC leaves no remainder, whatever the message."""
    name = F.col("p_name").cast("binary")

    def tail(value, size):
        return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(size)])

    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("d"))
    p = p.withColumn("a", K.crc_column(F.col("d"), 16, 0x8005)).withColumn("k", K.crc_column(F.col("d"), 16, 0x1021)).withColumn("o", K.crc32_open(F.col("d")))
    p = p.withColumn("a2", K.crc_column(F.concat("d", tail(F.col("a"), 2)), 16, 0x8005)).withColumn("k2", K.crc_column(F.concat("d", tail(F.col("k"), 2)), 16, 0x1021))
    p = p.withColumn("o2", K.crc_column(F.concat("d", tail(F.col("o"), 4)), 32, 0x04C11DB7, init=0xFFFFFFFF))
    return p.select("p_partkey", (F.col("a2") == 0).alias("arc_ok"), (F.col("o2") == 0).alias("open_ok"), (F.col("k2") == 0).alias("kermit_ok"))


@query("""
SELECT p_partkey, list_reduce(list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i::int, 1))), lambda a, b: xor(a, b)) AS lrc,
  CAST(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i::int, 1)))) % 128 AS integer) AS sum128 FROM part WHERE length(p_name) > 0""")
def E17_checksums(spark, sf_dir):
    b = K.byte_list(F.col("p_name").cast("binary"))
    return table(spark, sf_dir, "part").filter("length(p_name) > 0").select("p_partkey", K.xor_all(b).alias("lrc"), K.sum_mod128(b).alias("sum128"))


@query("SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS integer) AS distance, CAST(bit_count(event_id) % 2 = 1 AS boolean) AS odd, (event_id >> 2) & 15 AS field FROM events")
def C01_bits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).alias("distance"), (F.bit_count("event_id") % 2 == 1).alias("odd"), K.bits(F.col("event_id"), 2, 4).alias("field"))


@query("SELECT event_id, CAST(list_sum(list_transform(range(0, 8), lambda i: ((event_id >> i) & 1) << (7 - i))) AS bigint) AS reversed FROM events")
def C02_bit_reversal(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.reverse_bits(F.col("event_id") % 256).alias("reversed"))


@query("SELECT p_partkey, CAST(hamming(rpad(p_name, 40, ' '), rpad(reverse(p_name), 40, ' ')) AS integer) AS distance FROM part")
def C04_position_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", similarity.distance(F.col("p_name"), F.reverse("p_name"), 40).alias("distance"))


@query("SELECT o_orderkey, regexp_extract(t, '(^|[^0-9/])([0-9]{2})/([0-9]{2})($|[^0-9/])', 2) AS part, regexp_extract(t, '(^|[^0-9/])([0-9]{2})/([0-9]{2})($|[^0-9/])', 3) AS parts FROM (SELECT o_orderkey, 'page ' || lpad(CAST(o_custkey % 120 AS varchar), 2, '0') || '/' || lpad(CAST(o_orderkey % 130 AS varchar), 2, '0') || ' end' AS t FROM orders)")
def C05_page_counter(spark, sf_dir):
    t = F.concat(F.lit("page "), F.lpad((F.col("o_custkey") % 120).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.col("o_orderkey") % 130).cast("string"), 2, "0"), F.lit(" end"))
    # lpad() cuts what is longer, in both engines.
    found = lambda k: F.regexp_extract("t", r"(?<![0-9/])([0-9]{2})/([0-9]{2})(?![0-9/])", k)
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", found(1).alias("part"), found(2).alias("parts"))


@query("SELECT n_nationkey, n_name AS name FROM nation")
def C06_spaced_names(spark, sf_dir):
    spaced = F.array_join(F.split("n_name", ""), " ")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.regexp_replace(spaced, r"(?<=\S) (?=\S)", "").alias("name"))


@query("SELECT o_orderkey, CAST(TIMESTAMP '1992-01-01' + to_minutes(CAST(o_orderkey AS integer)) AS timestamp) AS at, CAST(CAST(DATE '1858-11-17' + CAST(45000 + o_custkey AS integer) AS date) AS varchar) AS day FROM orders")
def C09_epoch_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.epoch_minutes(F.col("o_orderkey").cast("int")).alias("at"), K.date_text(K.mjd_date(F.col("o_custkey") + 45000)).alias("day"))


@query("""
WITH n AS (SELECT o_orderkey, (o_orderkey * 977) % 2589408 AS n FROM orders), p AS (SELECT o_orderkey, n, n + (n // 17982) * 18 + CASE WHEN n % 17982 >= 2 THEN ((n % 17982 - 2) // 1798) * 2 ELSE 0 END AS c FROM n)
SELECT o_orderkey, lpad(CAST(c // 108000 AS varchar), 2, '0') || ':' || lpad(CAST(c // 1800 % 60 AS varchar), 2, '0') || ':' || lpad(CAST(c // 30 % 60 AS varchar), 2, '0') || ':' || lpad(CAST(c % 30 AS varchar), 2, '0') AS code, n AS back FROM p""")
def C11_drop_frame(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 977 % 2589408).alias("n")).withColumn("code", K.timecode_of(F.col("n")))
    part = lambda k: F.split("code", ":")[k].cast("int")
    return n.select("o_orderkey", "code", K.timecode_to_count(part(0), part(1), part(2), part(3)).alias("back"))


@query("SELECT event_id, CAST(((CAST(round(100 + 1.5 * event_id) AS bigint) % 86400) + 86400) % 86400 AS bigint) AS air FROM events")
def C13_clock_line(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.clock_line(F.col("event_id"), 1.5, 100.0).alias("air"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, coalesce(json_extract_string(props, '$.none'), 'x') AS other FROM events")
def C18_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("x")).alias("other"))


@query("SELECT page_id, CASE WHEN starts_with(upper(html), '<!DOCTYPE') THEN 'html' WHEN regexp_matches(substr(html, 1, 8), '^[\\x20-\\x7E\\s]+$') THEN 'text' END AS kind FROM pages")
def C20_type_sniff(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", "html", services.file_type(F.col("html").cast("binary")).alias("kind"))
    return d.select("page_id", F.when(F.upper("html").startswith("<!DOCTYPE"), "html").otherwise(F.col("kind")).alias("kind"))


#: Pages made of all texts from end to end: each document is a recording of its own, with as many pages of 24 rows as it needs.
WHOLE = """
WITH t AS (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents), r AS (SELECT doc_id, i AS row, substr(t, 40 * (i - 1)::int + 1, 40) AS line FROM t, unnest(range(1, (length(t) + 39) // 40 + 1)) AS u(i))"""

def _whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t")).filter("length(t) > 0")
    # A place in a text is found from its beginning, so long texts are cut into stretches first. The outer forms: for the others Spark
    # adds a filter that cleans the text again.
    parts = t.select(F.col("doc_id").alias("recording"), F.posexplode_outer(relations.stretches(F.col("t"), 4000, 0)).alias("j", "p"))
    every = F.sequence(F.lit(0), F.ceil(F.length("p") / 40).cast("int") - 1)
    lines = parts.select("recording", "j", F.explode_outer(F.transform(every, lambda i: F.struct(i.alias("i"), F.substring("p", 40 * i + 1, F.lit(40)).alias("text")))).alias("x"))
    at = F.col("j") * 100 + F.col("x.i")
    rows = lines.select("recording", F.struct(F.floor(at / 24).alias("n"), (at % 24 + 1).alias("row"), F.col("x.text").alias("text")).alias("x"))
    n = F.col("x.n")
    return rows.select("recording", (1 + n % 8).cast("int").alias("magazine"), F.floor(n / 8 % 200).cast("int").alias("page"), F.floor(n / 1600).cast("int").alias("subcode"), "x.row", "x.text")


#: Which of its document's pages a page is, from 0.
NTH = "subcode * 1600 + page * 8 + magazine - 1"


@query(WHOLE + " SELECT doc_id, CAST(row AS integer) AS row, rpad(line, 40, ' ') AS text FROM r")
def D01_rt_pages(spark, sf_dir):
    """Pages to packets, five copies with a bit wrong in one of them at each place in turn, and back by votes."""
    copies = streams.bent(streams.of_texts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    voted = streams.vote_pages(streams.page_sets(copies), least=3).filter("row > 0")
    return voted.select(F.col("recording").alias("doc_id"), (F.expr(NTH) * 24 + F.col("row")).cast("int").alias("row"), "text")


@query(WHOLE + " SELECT doc_id, sha256(string_agg(rtrim(line), chr(10) ORDER BY row)) AS text FROM r GROUP BY doc_id")
def K06_page_text(spark, sf_dir):
    text = streams.page_text(streams.page_sets(streams.of_texts(table(spark, sf_dir, "documents"), "doc_id", "text")))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.expr(NTH).alias("n"), "text"))), lambda x: x["text"]), "\n")
    return text.groupBy(F.col("recording").alias("doc_id")).agg(F.sha2(every.cast("binary"), 256).alias("text"))


@query("SELECT o_orderkey, CAST(1 + o_orderkey % 28 AS integer) AS day, CAST(1 + o_custkey % 12 AS integer) AS month, CAST(o_orderkey % 24 AS integer) AS hour, CAST(o_custkey % 60 AS integer) AS minute, CAST(o_orderkey % 4096 AS integer) AS cni FROM orders")
def D18_programme_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = services.make_label(1 + F.col("o_orderkey") % 28, 1 + F.col("o_custkey") % 12, F.col("o_orderkey") % 24, F.col("o_custkey") % 60, F.col("o_orderkey") % 4096, F.lit(0))
    return o.select("o_orderkey", services.programme_label(made).alias("l")).filter(services.plausible_label(F.col("l"))).select("o_orderkey", *[F.col(f"l.{c}").cast("int").alias(c) for c in ("day", "month", "hour", "minute", "cni")])


@query("""
WITH c AS (SELECT user_id, event_type, (event_id * 37) % 1000 AS minute_at FROM events), s AS (SELECT s_suppkey, s_suppkey * 20 AS a, 15 + s_suppkey % 30 AS m, lead(s_suppkey * 20) OVER (ORDER BY s_suppkey * 20) AS following FROM supplier)
SELECT user_id, minute_at, s_suppkey, following FROM c JOIN s ON minute_at >= a AND minute_at < a + m""")
def D36_on_air(spark, sf_dir):
    clock = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 37 % 1000).alias("minute_at"), F.lit("c").alias("channel"))
    slots = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 20).alias("a"), (15 + F.col("s_suppkey") % 30).alias("m"), F.lit("c").alias("channel"))
    return services.on_air(clock, slots, ["channel"], "minute_at", "a", "m").select("user_id", "minute_at", "s_suppkey", "following")


@query("SELECT CAST(source AS varchar) AS source, sha256(string_agg(part, '' ORDER BY k)) AS data, count(*) AS blocks, count(*) = 5 AS whole FROM (SELECT source, doc_id % 5 AS k, min(regexp_replace(text, '[^ -~]', '', 'g')) AS part FROM documents GROUP BY source, doc_id % 5) GROUP BY source")
def D24_files_from_blocks(spark, sf_dir):
    whole = F.regexp_replace("text", "[^ -~]", "")
    blocks = table(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 5).alias("k")).agg(F.min(whole).alias("t")).select("source", "k", F.col("t").cast("binary").alias("d"), F.lit(5).alias("n"))
    return services.assemble(blocks, "source", "k", "d", "n").select("source", F.sha2("data", 256).alias("data"), "blocks", "whole")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def A20_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT event_id, event_type FROM events WHERE (event_id - 1) % 100 = 0")
def S17_sampled_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("(event_id - 1) % 100 = 0").select("event_id", "event_type")


# --- copies and recovery


@query("""
WITH m AS (SELECT user_id, event_type, event_id, value > 50 AS v, lag(value > 50) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events)
SELECT user_id, event_type, event_id, v, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS integer) AS state FROM m WHERE p IS NULL OR p <> v""")
def G10_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("value") > 50).alias("v"))
    return clusters.snapshots(e, ["user_id"], "event_id", "event_type", "v")


@query("""
WITH f AS (SELECT user_id % 5 AS zone, event_type, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id % 5, event_type ORDER BY event_id) <= 20 THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY zone, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT zone, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS copies, max(event_id) - min(event_id) + 1 - count(*) AS missed FROM g GROUP BY zone, event_type, run""")
def G23_fold_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("zone"), "event_type", "event_id")
    return clusters.fold_messages(e, ["zone"], "event_id", "event_type", 20)


@query("""
WITH r AS (SELECT p_brand AS page, p_size % 4 AS sub, p_partkey % 7 AS row, min(p_name) AS t FROM part GROUP BY ALL), v AS (SELECT page, row, t AS top FROM (SELECT page, row, t, row_number() OVER (PARTITION BY page, row ORDER BY count(*) DESC, t) AS rn FROM r GROUP BY page, row, t) WHERE rn = 1),
a AS (SELECT page, row, max(hamming(rpad(t, 40, ' '), rpad(top, 40, ' '))) AS worst, count(DISTINCT sub) AS subs, min(top) AS top FROM r JOIN v USING (page, row) GROUP BY page, row), c AS (SELECT page, row, top FROM a WHERE worst <= 12 AND subs > 1),
w AS (SELECT p.page, p.sub, c.row, c.top FROM (SELECT DISTINCT page, sub FROM r) p JOIN c USING (page))
SELECT coalesce(w.page, r.page) AS page, coalesce(w.sub, r.sub) AS sub, coalesce(w.row, r.row) AS row, coalesce(r.t, w.top) AS t, r.t IS NULL AS filled FROM w FULL JOIN r ON w.page = r.page AND w.sub = r.sub AND w.row = r.row""")
def G25_shared_rows(spark, sf_dir):
    r = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("page"), (F.col("p_size") % 4).alias("sub"), (F.col("p_partkey") % 7).alias("row")).agg(F.min("p_name").alias("t"))
    return clusters.shared_rows(r, "page", "sub", "row", "t", most=12)


@query("""
WITH v AS (SELECT p_brand, p_size % 5 AS row, p_name AS t, count(*) AS n, max(p_partkey) AS seen FROM part GROUP BY ALL), s AS (SELECT a.p_brand, a.row, a.t, a.seen, sum(b.n) AS weight FROM v a JOIN v b ON a.p_brand = b.p_brand AND a.row = b.row AND hamming(rpad(a.t, 40, ' '), rpad(b.t, 40, ' ')) <= 8 GROUP BY ALL)
SELECT p_brand, row, t, CAST(weight AS bigint) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, row ORDER BY weight DESC, seen DESC, t DESC) AS rn FROM s) WHERE rn = 1""")
def G18_full_rows(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 5).alias("row"), F.col("p_name").alias("t"), F.col("p_partkey").alias("at"))
    return recovery.full_rows(r, ["p_brand"], "row", "t", "at", most=8)


@query("""
WITH h AS (SELECT user_id, event_id, CASE WHEN value <= 90 THEN CAST(length(event_type) AS integer) END AS page FROM events), c AS (SELECT *, lag(page) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM h),
n AS (SELECT user_id, b, page, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id, b) AS t, row_number() OVER (PARTITION BY user_id, b ORDER BY count(*) DESC, page) AS rn FROM c WHERE page IS NOT NULL AND b IS NOT NULL GROUP BY user_id, b, page), u AS (SELECT user_id, b, page AS g FROM n WHERE rn = 1 AND n >= 2 AND n * 100 >= t * 40)
SELECT c.user_id, c.event_id, coalesce(c.page, u.g) AS page, c.page IS NULL AND u.g IS NOT NULL AS guessed FROM c LEFT JOIN u ON c.user_id = u.user_id AND c.b = u.b""")
def G03_recover_headers(spark, sf_dir):
    h = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.lit(0).alias("row"), F.when(F.col("value") <= 90, F.length("event_type")).alias("page"))
    return recovery.recover_headers(h, ["user_id"], percent=40).select("user_id", F.col("seq").alias("event_id"), "page", "guessed")


@query("""
WITH r AS (SELECT DISTINCT source, lang, line FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 5), o AS (SELECT DISTINCT doc_id AS orphan, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 5),
m AS (SELECT orphan, lang, count(DISTINCT line) AS n FROM o JOIN (SELECT DISTINCT lang, line FROM r) USING (line) GROUP BY orphan, lang), k AS (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY n DESC, lang DESC) AS rn, lead(n, 1, 0) OVER (PARTITION BY orphan ORDER BY n DESC, lang DESC) AS second FROM m)
SELECT orphan, lang, n FROM k WHERE rn = 1 AND n >= 3 AND n >= 3 * second""")
def G04_own_orphans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 5")
    rows = d.select("lang", F.col("line").alias("text")).distinct().withColumn("row", F.col("text"))
    loose = d.select(F.col("doc_id").alias("orphan"), F.col("line").alias("text")).distinct().withColumn("row", F.col("text"))
    return recovery.own_orphans(rows, loose, ["lang"], "row", "text")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, i AS k, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 0 ELSE ascii(substr(o_orderpriority, i::int, 1)) END AS b FROM orders, unnest(range(1, 6)) AS t(i)),
v AS (SELECT o_custkey, k, b, row_number() OVER (PARTITION BY o_custkey, k ORDER BY count(*) DESC, b) AS rn FROM p WHERE b <> 0 GROUP BY o_custkey, k, b)
SELECT c.o_custkey, string_agg(lpad(upper(to_hex(coalesce(v.b, 0))), 2, '0'), '' ORDER BY c.k) AS data FROM (SELECT DISTINCT o_custkey, k FROM p) c LEFT JOIN v ON c.o_custkey = v.o_custkey AND c.k = v.k AND rn = 1 GROUP BY c.o_custkey""")
def A19_combine_copies(spark, sf_dir):
    char = lambda i: F.when((F.col("o_orderkey") + i) % 3 == 0, F.lit("00")).otherwise(F.hex(F.substring(F.col("o_orderpriority").cast("binary"), i, 1)))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.unhex(F.concat(*[char(i) for i in range(1, 6)])).alias("data"))
    return clusters.combine_copies(o, ["o_custkey"], "data", F.lit(1)).select("o_custkey", F.hex("data").alias("data"))


@query()
def G08_first_fit(spark, sf_dir):
    """Order-dependent; tested against its definition."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    return clusters.first_fit(p, ["p_brand"], ["p_partkey"], "p_name", most=12)


@query()
def G07_split_rotation(spark, sf_dir):
    """Connected parts by shared rows without a contradiction; tested against its definition."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), F.col("l_orderkey").alias("copy"), F.col("l_linenumber").alias("row"), "l_returnflag")
    # Some lines are there several times with different flags: the commonest stays.
    rows = votes.vote(lines, ["page", "copy", "row"], "l_returnflag")
    return clusters.split_rotation(rows, ["page"], "copy", "row", "l_returnflag")


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber AS part, count(*) AS copies FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL HAVING count(*) >= 3)
SELECT l_suppkey, part, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS k FROM c) WHERE k >= 2""")
def G12_rotations_by_counter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.format_string("news %02d/%02d", F.col("l_linenumber"), F.lit(5)).alias("t"))
    return recovery.rotations_by_counter(recovery.counters(rows, ["l_suppkey"], "t"), ["l_suppkey"])


@query()
def A08_vote_with_slip(spark, sf_dir):
    """Copies moved to agree before the vote; tested against copies that were slipped on purpose."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_name").cast("binary").alias("data"))
    return clusters.vote_with_slip(p, ["p_brand"], "p_partkey", "data").select("p_brand", F.hex("data").alias("data"), "copies", "dropped")
