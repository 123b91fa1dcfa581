"""URL filter [native]: host reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted by host, registered domain, public suffix and overall. Each level is a
beta-binomial whose prior mean is the posterior mean of the level above it; how strongly children follow their parent is
estimated from the counts of all children of a level by the method of moments. A host is blocked when the lower bound of its
posterior bad rate is over the limit: the quantile of its beta distribution, by the expansion of Cornish and Fisher up to the
skewness. Explicit rules go before the method.

Domains are those of the host's name without user and port. Suffixes of several labels are a parameter. An address, which has
neither, is a domain of its own, and all addresses together are as a suffix.

Everything is DataFrame operations. What reaches the driver is one row of sums for each level.

Defined results: a null url, or one without `://`, has an empty host and path and is judged as the host "" is; a host without
labelled pages has the posterior of its domain (or suffix, or all); outcomes with a null page reference or a null label are
not counted; of repeated outcomes of one page each counts; repeated pages give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Public suffixes of two labels that are taken where no others are given; all others are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr")
#: What stands for the suffix of an address.
ADDRESS = "(address)"
#: The rules become one expression, so their number is limited.
MAX_RULES = 1000


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and the dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$")


def _labels(name: Column, suffixes: Sequence[str]) -> Column:
    """How many labels the suffix of a name has."""
    out = F.lit(1)
    for n in sorted({x.count(".") + 1 for x in suffixes} - {1}):  # the longest wins
        out = F.when(F.substring_index(name, ".", -n).isin(*[x for x in suffixes if x.count(".") + 1 == n]), F.lit(n)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    name = name_of(host)
    return F.when(is_address(name), F.lit(ADDRESS)).otherwise(F.call_function("substring_index", name, F.lit("."), -_labels(name, suffixes)))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(F.call_function("substring_index", name, F.lit("."), -_labels(name, suffixes) - 1))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (its string), and its verdict; null where none fits. rules: (string such as `net/es/`, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits wins
        its_host, slash, rest = text.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def concentration(children: DataFrame, parent: str = "mu") -> float:
    """How many labelled pages the prior of this level is worth: the moment estimate of a beta-binomial's a + b, from n, k and the parent's mean of all children."""
    mu, n, k = F.col(parent), F.col("n"), F.col("k")
    spread = mu * (1 - mu)
    row = children.agg(F.sum(F.pow(k - n * mu, F.lit(2.0)) - n * spread).alias("extra"), F.sum(n * (n - 1) * spread).alias("pairs")).first()
    rho = (row.extra or 0.0) / row.pairs if row.pairs else 0.0
    rho = min(max(rho, 1e-4), 0.99)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """outcomes: host, bad (0 or 1) of each labelled page; hosts: host, repeats allowed. One row a host: host, host_n, host_bad, bad_rate, low, high."""
    bad = outcomes.filter("host IS NOT NULL AND bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    every = hosts.select("host").distinct().join(bad, "host", "left").select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    every = cut(every, "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    root = every.agg(*sums).first()
    top = ((root.k or 0) + 1) / ((root.n or 0) + 2)
    # A suffix, then a domain, then a host: each shrinks towards the mean of what it is in.
    level = cut(every.groupBy("suffix").agg(*sums).withColumn("mu", F.lit(top)), "suffixes")
    s = concentration(level)
    level = level.select("suffix", ((F.col("k") + s * F.col("mu")) / (F.col("n") + s)).alias("mu"))
    domains = cut(cut(every.groupBy("suffix", "domain").agg(*sums), "domains").join(level, "suffix"), "domains-mu")
    s = concentration(domains)
    domains = cut(domains.select("domain", ((F.col("k") + s * F.col("mu")) / (F.col("n") + s)).alias("mu")), "domain-means")
    own = cut(every.join(domains, "domain"), "hosts-mu")
    s = concentration(own)
    a, b = F.col("k") + s * F.col("mu"), F.col("n") - F.col("k") + s * (1 - F.col("mu"))
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    skew = 2 * (b - a) * F.sqrt(a + b + 1) / ((a + b + 2) * F.sqrt(a * b))
    low, high = (F.least(F.greatest(mean + sd * (q + (z * z - 1) * skew / 6), F.lit(0.0)), F.lit(1.0)) for q in (-z, z))
    return own.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_bad"), F.round(mean, 6).alias("bad_rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), *, page_id: str = "page_id", url: str = "url", max_bad: float = 0.25, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_n, host_bad, bad_rate, low, high for each row of pages.

    outcomes: url, bad (0 or 1), a row for each labelled page. A host is blocked when low, the lower bound of its bad rate, is over max_bad.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    known = cut(host_reputation(outcomes.select(url_host(F.col("url")).alias("host"), "bad"), parts, z, suffixes), "reputation")
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "host_n", "host_bad", "bad_rate", "low", "high")
