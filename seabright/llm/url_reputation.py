"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Beta-binomial priors shrink them along
host -> registered domain -> public suffix -> everything: each level's prior mean is its parent's
posterior mean, and its prior strength comes from the over-dispersion of the children about that
mean (method of moments). A host passes when the lower posterior bound of its good-page rate
reaches ``min_good``. Explicit rules override the statistics.

Scaling: only counts are shuffled before the last join. Hosts are pre-aggregated on the map side,
so a host with a third of all pages costs one partial row a task; the last join on the host is a plain
equi-join that adaptive execution splits when one host dominates.

The hierarchy leaves out user names, ports and final dots; an IP address is its own domain and shares only the overall prior.

Edge cases: a null url, or one without ``://``, has empty host and path and is judged by the overall prior
like any other unseen host. Null page ids are kept. Repeated label rows of one id each count, and so do the labels of an id on each of its repeated page rows. Extra columns are ignored. Very long urls are read like others.
Hosts with no labels inherit their domain's (then suffix's) posterior. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seabright.llm.common import materialize

#: Under a country's two letters, labels that make a suffix with it (co.uk, com.au). Fixed values.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Other suffixes of two labels; pass a longer list as needed.
TWO_LABEL_SUFFIXES: tuple[str, ...] = ()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    pattern: str  # "host/path-prefix"
    action: str  # "allow" or "block"

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, _after_scheme(url))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, _after_scheme(url))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))


def site_of(host: Column) -> Column:
    """The name that has a reputation: a host without user name, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def is_address(site: Column) -> Column:
    """Whether a site is an IP address, which has no suffix and is its own domain."""
    return site.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def _ends_in_pair(site: Column, two_label: Sequence[str]) -> Column:
    pair = F.substring_index(site, ".", -2)
    country = F.substring_index(pair, ".", 1).isin(*SECOND_LABELS) & F.substring_index(pair, ".", -1).rlike("^[a-z][a-z]$") & (F.locate(".", pair) > 0)
    return country | pair.isin(*two_label) if two_label else country


def suffix_of(site: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    plain = F.when(_ends_in_pair(site, two_label), F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))
    return F.when(is_address(site), F.lit("")).otherwise(plain)


def domain_of(site: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    plain = F.when(_ends_in_pair(site, two_label), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))
    return F.when(is_address(site), site).otherwise(plain)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Pattern and action of the longest rule that fits; rules are a short configured list."""
    pattern, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern, action = F.when(fits, rule.pattern).otherwise(pattern), F.when(fits, rule.action).otherwise(action)
    return pattern, action


def _strength(children: DataFrame, mean: str) -> float:
    """Prior strength a+b of children (good, total) about their parents' mean, from the moment estimate of over-dispersion."""
    n, p = F.col("total"), F.col("good") / F.col("total")
    row = children.where("total > 0").agg(
        F.sum(n * (p - F.col(mean)) * (p - F.col(mean))).alias("s"),
        F.sum(F.col(mean) * (1 - F.col(mean))).alias("v"),
        F.sum((n - 1) * F.col(mean) * (1 - F.col(mean))).alias("w"),
    ).first()
    if not row["w"]:
        return 1.0
    rho = min(0.5, max(0.001, (row["s"] - row["v"]) / row["w"]))
    return 1.0 / rho - 1.0


def _posterior(mean: Column, strength: float) -> Column:
    return (mean * strength + F.col("good")) / (F.lit(strength) + F.col("total"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.6448536269514722, min_good: float = 0.6, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(site, posterior mean, lower bound) of every site of ``pages`` (page_id, site).

    ``outcomes``: (page_id, good, total), unique by page_id.
    """
    hosts = (
        pages.join(outcomes, "page_id", "left")
        .groupBy("site")
        .agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        .withColumns({"domain": domain_of(F.col("site"), two_label), "suffix": suffix_of(F.col("site"), two_label)})
    )
    hosts = materialize(hosts, "hosts")  # counts of each host, read for every level
    sums = [F.sum("good").alias("good"), F.sum("total").alias("total")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()
    overall = (1.0 + (whole["good"] or 0)) / (2.0 + (whole["total"] or 0))
    suffixes = suffixes.withColumn("mean0", F.lit(overall))
    k0 = _strength(suffixes, "mean0")
    suffixes = suffixes.select("suffix", _posterior(F.lit(overall), k0).alias("mean1"))
    domains = domains.join(suffixes, "suffix")
    k1 = _strength(domains, "mean1")
    domains = domains.select("domain", _posterior(F.col("mean1"), k1).alias("mean2"))
    hosts = hosts.join(domains, "domain")
    k2 = _strength(hosts, "mean2")
    mean = _posterior(F.col("mean2"), k2)
    spread = F.sqrt(mean * (1 - mean) / (F.col("total") + F.lit(k2 + 1)))
    return hosts.select("site", mean.alias("reputation"), (mean - F.lit(z) * spread).alias("lower_bound")).withColumn(
        "verdict", F.when(F.col("lower_bound") >= min_good, "allow").otherwise("block")
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], z: float = 1.6448536269514722, min_good: float = 0.6, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) judge the page of the same id; a page is good when quality is 1 and toxic is not 1.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("site", site_of(F.col("host")))
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcomes = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.sum(good.cast("long")).alias("good"), F.count("*").alias("total"))
    )
    reputation = host_reputation(parsed.select("page_id", "site"), outcomes, z, min_good, two_label)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return (
        parsed.withColumns({"rule": rule, "action": action})
        .join(reputation.select("site", F.col("verdict").alias("by_host")), "site")
        .select("page_id", "host", "path", "rule", F.coalesce("action", "by_host").alias("verdict"))
    )
