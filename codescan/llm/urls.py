"""URL filters: path rules, and host reputation by empirical Bayes.

Labelled outcomes of pages are counted for each host.  The rate of bad outcomes of a suffix is
shrunk to that of all pages, that of a registered domain to its suffix, that of a host to its
domain; how strongly, the spread of the rates at each level decides (beta-binomial priors, by
the method of moments).  A host whose posterior rate is surely above the limit is blocked.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.session import cut_lineage

# Second-level names under which domains are registered.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
                "com.br", "co.in", "com.cn", "com.mx", "co.za", "com.tr", "co.kr")
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LIMIT, DEVIATIONS = 0.5, 1.645  # share of bad pages; how many standard deviations the bound is below the mean
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits a host (itself or a parent domain) and the beginning of its path; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted({r for r, _ in rules}, key=lambda r: (len(r), r)):  # the longest is tested first
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host without its port."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    second = two.isin(*SECOND_LEVEL)
    suffix = F.when(second, two).otherwise(F.substring_index(bare, ".", -1))
    return suffix, F.when(second, F.substring_index(bare, ".", -3)).otherwise(two)


def _strength(level: DataFrame) -> float:
    """How many pages the prior of a level counts for: (n, k, mean) per child, mean of its parent."""
    seen = level.where("n > 0").agg(
        F.count(F.lit(1)).alias("groups"), F.avg(F.pow(F.col("k") / F.col("n") - F.col("mean"), 2)).alias("spread"),
        F.avg(F.expr("mean * (1 - mean) / n")).alias("noise"), F.avg(F.expr("mean * (1 - mean)")).alias("most")).first()
    if not seen["groups"]:
        return 1.0
    between = max(seen["spread"] - seen["noise"], 1e-6)
    return min(max(seen["most"] / between - 1, 1.0), 1000.0)


def _shrink(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with the mean of their parent and their own posterior (alpha, beta, rate).

    A prior counts for no more pages than its parent knows of: where a level has few groups or all
    are alike, a few outcomes elsewhere settle nothing.
    """
    level = children.join(parents.select(key, F.col("rate").alias("mean"), F.col("total").alias("most")), key)
    weight = F.least(F.lit(_strength(level)), F.col("most"))
    alpha, beta = F.col("k") + weight * F.col("mean"), F.col("n") - F.col("k") + weight * (1 - F.col("mean"))
    return level.withColumn("alpha", alpha).withColumn("beta", beta).withColumn("rate", alpha / (alpha + beta)).withColumn(
        "total", alpha + beta).drop("mean", "most")


def host_reputation(outcomes: DataFrame, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, n, k, rate, bound, verdict) of the hosts of (host, n, k): pages with an outcome, bad ones among them.

    ``bound`` is the lower bound of the posterior rate; a host is blocked if it is above the limit.
    A host without labelled pages has the rate of its domain.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = outcomes.withColumn("suffix", suffix).withColumn("domain", domain)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n"), F.sum("k")).first()
    pages = (total[0] or 0) + 2
    root = suffixes.select("suffix", F.lit(((total[1] or 0) + 1) / pages).alias("rate"), F.lit(float(pages)).alias("total"))
    suffixes = _shrink(suffixes, root, "suffix")
    domains = _shrink(domains, suffixes, "suffix")
    hosts = _shrink(hosts, domains.select("domain", "rate", "total"), "domain")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("alpha") + F.col("beta") + 1))
    bound = F.col("rate") - F.lit(deviations) * spread
    return hosts.select("host", "n", "k", "rate", bound.alias("bound"),
                        F.when(bound > limit, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url",
                label_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page.

    A page's outcome is that of the label with its id: bad if the quality is 0 or it is toxic (the
    worst of repeated labels; a null says nothing).  A rule decides before the reputation of the
    host.  Repeated pages count as often as they come; a page without url has the empty host.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.greatest(F.when(F.col(quality) == 0, 1).when(F.col(quality).isNotNull(), 0),
                     F.when(F.col(toxic) == 1, 1).when(F.col(toxic).isNotNull(), 0))
    known = labels.select(F.col(label_id).alias("_id"), bad.alias("bad")).where("bad IS NOT NULL AND _id IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("bad").alias("bad"))
    outcomes = rows.join(known, rows["page_id"] == known["_id"], "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    judged = host_reputation(cut_lineage(outcomes), **options).select(F.col("host").alias("_host"), F.col("verdict").alias("_verdict"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = F.lit(None).cast("string")
    for name, verdict in rules:
        ruled = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumn("rule", rule).join(judged, F.col("host") == F.col("_host"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.col("_verdict")).alias("verdict"))
