"""URL filter by empirical-Bayes host reputation, under fixed rules.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. Each level's counts
are shrunk towards the level above through a beta prior whose strength is estimated from the spread of that
level's rates (method of moments on a beta-binomial). A host is blocked if the lower bound of its posterior
bad-page rate exceeds ``block_above``. Hosts without labels take the posterior of their domain or suffix.

Outcomes are pre-aggregated by host before anything else moves; host tables are joined to pages as written tables
(broadcast below Spark's threshold, else shuffled, with hot hosts split by adaptive execution).

Defined results: a null url, or one without ``://``, has empty host and path and takes the prior's verdict; no
labels at all give ``allow``; of several fitting rules the longest wins, then the first by text; rules beat the
reputation; rows are judged one by one, so repeated rows are kept; columns named like the new ones are replaced; urls are taken whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.session import written

BLOCK_ABOVE = 0.5
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Default suffixes of two labels under which names are registered; all others are one label. A parameter: pass a
#: longer list, a few thousand entries at most, where the corpus needs it.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    after = url.substr(F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), path).otherwise("")


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(last)


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*suffixes), three).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, else null; rules: (verdict, host, path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(level: DataFrame) -> DataFrame:
    """One row: the prior strength that the spread of a level's rates (columns n, k) suggests."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = level.where("n > 0").agg(
        F.sum("n").cast("double").alias("N"), F.count(F.lit(1)).cast("double").alias("m"), F.sum(n * n).alias("nn"),
        F.sum("k").cast("double").alias("K"), F.sum(k * k / n).alias("kk"),
    )
    m, total = F.col("m"), F.col("N")
    between = (F.col("kk") - F.col("K") * F.col("K") / total) / (m - 1)
    within = (F.col("K") - F.col("kk")) / (total - m)
    size = (total - F.col("nn") / total) / (m - 1)
    rho = F.try_divide(between - within, between + (size - 1) * within)
    guarded = F.when((m > 1) & (total > m), F.when(rho > 0, F.try_divide(1 - rho, rho)).otherwise(MAX_STRENGTH)).otherwise(1.0)
    return sums.select(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(guarded, F.lit(1.0)))).alias("strength"))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n, k, posterior mean ``rate`` and lower bound ``low`` for each row of ``hosts`` (host, distinct).

    outcomes: (host, bad) with bad 0 or 1, or null if unlabelled. One row for each host passes on; the one-row
    strengths and totals are scalars that are joined without keys.
    """
    counted = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    counted = hosts.join(counted, "host", "left").fillna(0, ["n", "k"])
    by_host = written(counted.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)), "hosts")
    by_domain = written(by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    by_suffix = written(by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    (top, s_suffix, s_domain, s_host) = (
        by_suffix.agg(F.coalesce(F.try_divide(F.sum("k").cast("double"), F.sum("n").cast("double")), F.lit(0.0))).first()[0],
        *(_strength(t).first()[0] for t in (by_suffix, by_domain, by_host)),
    )
    shrunk = lambda n, k, s, prior: (k + s * prior) / (n + s)
    up = by_suffix.select("suffix", shrunk(F.col("n"), F.col("k"), F.lit(s_suffix), F.lit(top)).alias("suffix_rate"))
    mid = by_domain.join(up, "suffix").select("domain", "suffix", shrunk(F.col("n"), F.col("k"), F.lit(s_domain), F.col("suffix_rate")).alias("domain_rate"))
    low = by_host.join(mid, ["domain", "suffix"])
    a = F.col("k") + F.lit(s_host) * F.col("domain_rate")
    b = F.col("n") - F.col("k") + F.lit(s_host) * (1 - F.col("domain_rate"))
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return low.select("host", "n", "k", mean.alias("rate"), (mean - F.lit(z) * sd).alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], block_above: float = BLOCK_ABOVE, z: float = Z, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, verdict, host_n, host_bad and bad_low.

    outcomes: (url, bad), the labelled pages.
    """
    plain = pages.drop("host", "path", "rule", "verdict", "host_n", "host_bad", "bad_low")
    parsed = plain.withColumn("host", host_of(plain["url"])).withColumn("path", path_of(plain["url"]))
    hosts = parsed.select("host").distinct()
    judged = host_reputation(hosts, outcomes.select(host_of(F.col("url")).alias("host"), "bad"), z, suffixes)
    table = written(judged.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_bad"), F.col("low").alias("bad_low")), "reputation")
    ruled = parsed.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).join(table, "host", "left")
    own = F.when(F.col("bad_low") > block_above, "block").otherwise("allow")
    final = ruled.withColumn("rule", F.col("_r.rule")).withColumn("verdict", F.coalesce(F.col("_r.verdict"), own))
    return final.select(*[plain[c] for c in plain.columns], "host", "path", "rule", "verdict", "host_n", "host_bad", "bad_low")
