"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

#: A-Z in lower case, other letters left alone.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    try_cast(regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/([0-9]+)(/|$)', 1) AS bigint) AS shows
  FROM pages),
o AS (
  SELECT p.host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad
  FROM p JOIN labels l ON p.shows = l.doc_id WHERE coalesce(toxic, quality) IS NOT NULL),
t AS (
  SELECT host, name, string_split(name, '.') AS parts, regexp_matches(name, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$') AS address,
    CASE WHEN array_to_string(string_split(name, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'ne.jp', 'com.br', 'com.cn', 'com.mx', 'co.in', 'co.za', 'com.tr') THEN 2 ELSE 1 END AS labels
  FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM p)),
h AS (
  SELECT a.host, CASE WHEN address THEN name ELSE array_to_string(parts[-labels - 1:], '.') END AS dom, CASE WHEN address THEN '(address)' ELSE array_to_string(parts[-labels:], '.') END AS suf, coalesce(b.n, 0) AS n, coalesce(b.k, 0) AS k
  FROM t a LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS k FROM o GROUP BY host) b ON a.host = b.host),
r AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mu FROM h),
s0 AS (SELECT suf, sum(n)::double AS n, sum(k)::double AS k FROM h GROUP BY suf),
s1 AS (SELECT 1 / least(greatest(coalesce(sum(power(k - n * mu, 2) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0), 0), 1e-4), 0.99) - 1 AS s FROM s0, r),
s2 AS (SELECT suf, (k + s * mu) / (n + s) AS mu FROM s0, r, s1),
d0 AS (SELECT dom, suf, sum(n)::double AS n, sum(k)::double AS k FROM h GROUP BY dom, suf),
d1 AS (SELECT 1 / least(greatest(coalesce(sum(power(k - n * mu, 2) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0), 0), 1e-4), 0.99) - 1 AS s FROM d0 JOIN s2 USING (suf)),
d2 AS (SELECT dom, (k + s * mu) / (n + s) AS mu FROM d0 JOIN s2 USING (suf), d1),
h1 AS (SELECT 1 / least(greatest(coalesce(sum(power(k - n * mu, 2) - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0), 0), 1e-4), 0.99) - 1 AS s FROM h JOIN d2 USING (dom)),
h2 AS (SELECT host, n, k, k + s * mu AS a, n - k + s * (1 - mu) AS b FROM h JOIN d2 USING (dom), h1),
h3 AS (
  SELECT host, n::bigint AS host_n, k::bigint AS host_bad, round(a / (a + b), 6) AS bad_rate,
    round(least(greatest(m + sd * (-1.645 + (1.645 * 1.645 - 1) * skew / 6), 0), 1), 6) AS low,
    round(least(greatest(m + sd * (1.645 + (1.645 * 1.645 - 1) * skew / 6), 0), 1), 6) AS high
  FROM (SELECT *, a / (a + b) AS m, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS sd, 2 * (b - a) * sqrt(a + b + 1) / ((a + b + 2) * sqrt(a * b)) AS skew FROM h2)),
f AS (
  SELECT p.page_id, host, path, host_n, host_bad, bad_rate, low, high,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN h3 USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.25 THEN 'block' ELSE 'allow' END AS verdict,
  host_n, host_bad, bad_rate, low, high
FROM f
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
x AS (SELECT rid, count(DISTINCT j) AS hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
y AS (SELECT rid, count(*) AS items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS varchar) AS t FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(hit, 0) AS bigint) AS n_hit, CAST(coalesce(items, 0) AS bigint) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON x = a.rid JOIN n b ON y = b.rid WHERE 100 * i >= 80 * (a.n + b.n - i)),
r AS (SELECT rid, rid AS to_rid FROM d UNION SELECT r.rid, l.y FROM r JOIN l ON r.to_rid = l.x),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.to_rid GROUP BY r.rid)
SELECT doc_id, CAST(coalesce(n, 0) AS bigint) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM g JOIN m USING (g)),
k AS (
  SELECT e.rid, count(*) FILTER (x.j IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY e.j) FILTER (x.j IS NULL) AS kept
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) e LEFT JOIN x ON e.rid = x.rid AND e.j = x.j GROUP BY e.rid)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(gone, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

OP5 = """
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::double)) AS q FROM embeddings),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS bigint) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

SQL = {"op5_top_k": OP5, "op10_repeated_passages": OP10, "op3_near_duplicates": OP3, "op1_host_reputation": OP1, "op8_benchmark_leaks": OP8}
