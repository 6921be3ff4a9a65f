"""Empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (good or bad) are added up by host, registered domain and
suffix. Each level's rate is shrunk towards its parent's by a beta-binomial
prior whose strength is estimated from the spread of the rates at that level
(method of moments): a host with few labelled pages is judged mostly by its
domain, a domain with few by its suffix. A host is blocked if the lower bound
of its posterior rate of bad pages is above the limit; a rule that fits the url
goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.llm.common import stored

#: Rules (verdict, host, path), the given fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels below which sites are registered (fixed values, common ones).
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "co.kr", "com.cn",
            "com.tw", "com.br", "com.ar", "com.mx", "com.tr", "co.in", "co.za", "co.il")
#: Hosts that are addresses, not names.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
#: Host's bad pages, at most, and standard deviations of the posterior bound.
MAX_BAD, Z = 0.5, 1.645
#: The strength of a prior, in pages, stays within these.
STRENGTH = (1.0, 1000.0)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.coalesce(url.substr(F.length(rest) + 4, F.length(url)), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def site_of(host: Column) -> Column:
    """The host without user info, port and trailing dots: what its reputation is filed under."""
    bare = F.regexp_replace(host, "^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, ":[0-9]*$", ""), r"\.+$", "")


def is_address(site: Column) -> Column:
    return site.rlike(ADDRESS)


def suffix_of(site: Column) -> Column:
    """The last label, or the last two where sites are registered below both; ``ip`` for an address."""
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), "ip").when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    """Registered domain: the suffix and the label before it; an address is its own."""
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), site).when(two.isin(*SUFFIXES), F.substring_index(site, ".", -3)).otherwise(two)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host`` + ``path``) and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Overall rate and prior strength from ``n, bad`` per group, by the method of moments.

    The spread of the groups' rates beyond that of the binomial gives the
    variance of the prior, hence its strength in pages; it is at most that of all
    labelled pages.
    """
    p = F.col("bad") / F.col("n")
    n, bad, k, squares, moved = groups.filter("n > 0").agg(
        F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("n").cast("double") * F.col("n")),
        F.sum(F.col("bad") * p)).first()
    if not n:
        return 0.5, STRENGTH[0]
    rate = (bad + 0.5) / (n + 1)
    spread = moved / n - (bad / n) ** 2  # mean of (rate of the group - overall rate) squared, by pages
    left = 1 - squares / (n * n)
    between = (spread - rate * (1 - rate) * (k - 1) / n) / left if left > 0 else 0.0
    strength = rate * (1 - rate) / between - 1 if between > 0 else STRENGTH[1]
    return rate, min(max(strength, STRENGTH[0]), STRENGTH[1], n + 1.0)


def reputation(pages: DataFrame, z: float = Z) -> DataFrame:
    """``host, n, bad, rate, low, high`` per host from rows ``host, bad`` (1, 0, or null if not labelled).

    ``rate`` is the posterior mean of bad pages, ``low`` and ``high`` its bounds.
    """
    site = site_of(F.col("host"))
    hosts = stored(pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select(
        "host", domain_of(site).alias("domain"), suffix_of(site).alias("suffix"), "n", "bad"), "hosts")
    add = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = stored(hosts.groupBy("domain", "suffix").agg(*add), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(*add), "suffixes")
    overall, of_suffix = _strength(suffixes)
    of_domain, of_host = _strength(domains)[1], _strength(hosts)[1]

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("bad") + prior * strength) / (F.col("n") + strength)

    by_suffix = suffixes.select("suffix", shrunk(F.lit(overall), of_suffix).alias("prior"))
    by_domain = stored(domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("prior"), of_domain).alias("prior")), "domain-rates")
    rate, pages_ = shrunk(F.col("prior"), of_host), F.col("n") + of_host + 1
    width = z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / pages_)
    return hosts.join(by_domain, "domain").select("host", "n", "bad", rate.alias("rate")).select(
        "*", F.greatest(F.lit(0.0), F.col("rate") - width).alias("low"), F.least(F.lit(1.0), F.col("rate") + width).alias("high"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES,
               max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, n_labelled, n_bad, rate, low, high``.

    ``outcomes`` has ``page_id, bad`` (0 or 1); of repeated outcomes of a page the
    worst holds, null ones are left out. A null url or one without ``://`` has an
    empty host, which is judged like any other.
    """
    host, path = host_path(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").cast("bigint").alias("bad"))
    hosts = stored(reputation(rows.select("page_id", "host").join(known, "page_id", "left"), z), "host-rates")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return rows.join(hosts, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "rate", "low", "high")
