"""Empirical-Bayes reputation of hosts, and pages judged by rules and by reputation.

Labelled outcomes of pages are counted per host. A host's share of good pages is shrunk towards that of
its registered domain, the domain's towards its suffix's, and the suffix's towards that of all pages: each
level has a beta prior whose mean is the posterior mean one level up, and whose weight is fitted to how far
the groups of that level lie apart (a moment estimate of the beta-binomial's correlation). A page is
blocked when even the upper bound of its host's posterior stays below a wanted share of good pages, so
that doubt doesn't block.

All steps are built-in functions. Outcomes are counted before they are shuffled; levels are joined with
salted keys, as one suffix, domain or host may hold most rows of the level below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import attach, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Second-level names under which two-letter country domains sell names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (ties: the first in order of text), else null.

    A rule fits its host and all subdomains, where the path starts with the rule's. The rules become one
    expression, so they should be some hundreds at most.
    """
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def registered(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host.

    The suffix is the longest of ``suffixes`` that ends the host, else two names below a two-letter
    country domain that sells names on its second level, else the last name; the domain has one name
    more. User and port don't count. Addresses in digits are their own domain and suffix.
    """
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    names = F.split(name, r"\.")
    last, second = F.element_at(names, -1), F.try_element_at(names, F.lit(-2))
    paired = (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    suffix = F.when(F.coalesce(paired, F.lit(False)), F.concat_ws(".", second, last)).otherwise(last)
    for known in sorted(suffixes, key=len):
        ends = (name == known) | F.endswith(name, F.lit("." + known))
        suffix = F.when(ends, known).otherwise(suffix)
    suffix = F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(suffix)
    own = F.split(F.left(name, F.length(name) - F.length(suffix) - 1), r"\.")
    domain = F.when(F.length(name) > F.length(suffix) + 1, F.concat_ws(".", F.element_at(own, -1), suffix))
    return F.coalesce(domain, suffix), suffix


def _weight(groups: DataFrame) -> float:
    """The prior's weight in pages, from groups with n, good and their prior's ``mean``."""
    spread = F.col("mean") * (1 - F.col("mean"))
    off = F.col("good") - F.col("n") * F.col("mean")
    above, possible = (
        groups.filter("n > 0").agg(F.sum(off * off / F.col("n") - spread), F.sum(spread * (F.col("n") - 1))).first()
    )
    if not possible:
        return 1.0
    alike = min(max(above / possible, 0.001), 0.5)
    return (1 - alike) / alike


def _posterior(groups: DataFrame) -> DataFrame:
    """Groups with ``alpha`` and ``beta`` of their posterior instead of their prior's ``mean``."""
    weight = _weight(groups)
    alpha = F.col("good") + weight * F.col("mean")
    beta = F.col("n") - F.col("good") + weight * (1 - F.col("mean"))
    return groups.withColumns({"alpha": alpha, "beta": beta}).drop("mean")


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """host, domain, suffix, n, good, mean, lower, upper: the posterior of each host's share of good pages.

    ``outcomes`` has a row per page: host, and good (boolean; null where the page has no label, so that
    hosts without labels get their domain's reputation). Bounds lie ``z`` standard deviations from the
    mean. Without any label all hosts have mean 0.5. A null host counts as the empty one; repeated rows
    count each; further columns aren't read; an empty table gives no rows.
    """
    domain, suffix = registered(F.col("host"), suffixes)
    counted = outcomes.select(F.coalesce("host", F.lit("")).alias("host"), F.col("good").cast("long").alias("good"))
    hosts = stored(
        counted.groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        .withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    tops = stored(domains.groupBy("suffix").agg(*sums), "suffixes")
    n, good = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    tops = _posterior(tops.withColumn("mean", F.lit((good + 1.0) / (n + 2.0))))
    above = tops.select("suffix", mean.alias("mean"))
    domains = _posterior(stored(attach(domains, above, "suffix", "domain"), "domain-priors"))
    above = domains.select("domain", mean.alias("mean"))
    hosts = _posterior(stored(attach(hosts, above, "domain", "host"), "host-priors"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("alpha") + F.col("beta") + 1))
    return (
        hosts.withColumn("mean", mean)
        .withColumns({"lower": F.col("mean") - z * sd, "upper": F.col("mean") + z * sd})
        .select("host", "domain", "suffix", "n", "good", "mean", "lower", "upper")
    )


def judged_pages(
    pages: DataFrame, rules: Sequence[Rule], suffixes: Sequence[str] = (), least: float = 2 / 3, z: float = 1.645
) -> DataFrame:
    """page_id, host, path, rule, verdict: pages judged by the longest rule that fits, else by reputation.

    The verdicts of rules are the labelled outcomes that hosts' reputations learn from. A page without a
    rule is blocked where the upper bound of its host's share of good pages is below ``least``, and
    allowed otherwise. A null url, or one without ``://``, has an empty host and path, and the reputation
    of the empty host. Rows that repeat, and null page ids, are rows of their own; further columns
    aren't read; very long urls are taken whole; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = split.withColumns({"rule": rule, "verdict": verdict})
    outcomes = known.select("host", (F.col("verdict") == "allow").alias("good"))
    blocked = host_reputation(outcomes, suffixes, z).filter(F.col("upper") < least)
    facts = stored(blocked.select("host", F.lit("block").alias("found")), "blocked-hosts")
    open_ = known.filter("rule is null").withColumn("_deal", F.xxhash64("page_id", "path"))
    judged = attach(open_, facts, "host", "_deal").withColumn("verdict", F.coalesce("found", F.lit("allow")))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return known.filter("rule is not null").select(columns).unionByName(judged.select(columns))
