"""Rules, registered domains and reputations of hosts against plain Python."""

import math
import re

from pyspark.sql import functions as F

from fleetgauge.llm import host_reputation as hr
from fleetgauge.llm.queries import OPEN_SUFFIXES, URL_RULES

URLS = [
    None,
    "",
    "no-scheme.org/a",
    "http://",
    "http://ORG/x",
    "http://a.ORG/Es/",
    "https://example.org/es/1?x=/en/1",
    "https://WWW.Example.org/en/12#f",
    "https://example.org/en/2",
    "https://notexample.org.evil.com/de/3",
    "https://a.com/fr",
    "https://a.com/fr/x://y/de/",
    "https://b.a.com/de/",
    "https://u:p@b.a.com:80/de/",
    "https://b.a.com?u=/fr/",
    "https://b.a.com/en/#/de/",
    "https://example.org",
    "ftp://10.0.0.1:8080/a\nb?c",
    "http://ÄÖ.co.uk/é",
    "http://shop.some.co.uk/" + "long/" * 20_000,
    "http://shop.some.co.uk/",
    "http://shop.some.co.uk/",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def plain_reputation(rows, parents, z=1.645):
    """Means and bounds per host from (host, good or None) rows; ``parents`` gives domain and suffix."""

    def counted(key):
        found = {}
        for host, good in rows:
            n, k = found.get(key(host), (0, 0))
            found[key(host)] = (n + (good is not None), k + bool(good))
        return found

    def posterior(groups, prior):
        above = possible = 0.0
        for name, (n, k) in groups.items():
            m = prior(name)
            if n:
                above += (k - n * m) ** 2 / n - m * (1 - m)
                possible += m * (1 - m) * (n - 1)
        w = 1 / min(max(above / possible, 0.001), 0.5) - 1 if possible else 1.0
        return {name: (k + w * prior(name), n - k + w * (1 - prior(name))) for name, (n, k) in groups.items()}

    labelled = [good for _, good in rows if good is not None]
    root = (sum(labelled) + 1) / (len(labelled) + 2)
    mean = lambda ab: ab[0] / (ab[0] + ab[1])
    tops = posterior(counted(lambda h: parents[h][1]), lambda name: root)
    domains = {parents[h]: None for h, _ in rows}
    of = {d: s for d, s in domains}
    middle = posterior(counted(lambda h: parents[h][0]), lambda name: mean(tops[of[name]]))
    hosts = posterior(counted(lambda h: h), lambda name: mean(middle[parents[name][0]]))
    found = {}
    for host, (a, b) in hosts.items():
        m = a / (a + b)
        sd = math.sqrt(m * (1 - m) / (a + b + 1))
        found[host] = (m, m - z * sd, m + z * sd)
    return found


def test_registered_domains(spark):
    want = {
        "": ("", ""),
        "localhost": ("localhost", "localhost"),
        "a.com": ("a.com", "com"),
        "x.y.a.com:80": ("a.com", "com"),
        "u@shop.some.co.uk": ("some.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "x.some.de": ("some.de", "de"),
        "www.site.example.org": ("site.example.org", "example.org"),
        "example.org": ("example.org", "example.org"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
        "a..com": (".com", "com"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = hr.registered(F.col("host"), OPEN_SUFFIXES)
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == want


def test_reputations_shrink_level_by_level(spark):
    counts = {"a.x.com": (40, 4), "b.x.com": (3, 0), "c.x.com": (0, 0), "a.y.com": (60, 57), "z.com": (1, 1), "q.net": (0, 0), "p.org": (30, 29)}
    rows = [(h, k < good) for h, (n, good) in counts.items() for k in range(n)] + [(h, None) for h in counts] * 2
    df = spark.createDataFrame(rows, "host string, good boolean").withColumns({"n": F.lit("x"), "mean": F.lit(1), "suffix": F.lit(0)})
    got = {r.host: r for r in hr.host_reputation(df).collect()}
    parents = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in counts}
    want = plain_reputation(rows, parents)
    assert set(got) == set(want)
    for host, figures in want.items():
        r = got[host]
        assert (r.domain, r.suffix, r.n, r.good) == (*parents[host], *counts[host])
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((r.mean, r.lower, r.upper), figures))
    # A host without labels stands nearer to its domain than a host of another domain does.
    assert got["b.x.com"].mean < got["c.x.com"].mean < got["q.net"].mean < got["a.y.com"].mean
    none = spark.createDataFrame([("a.com", None), (None, None)], "host string, good boolean")
    assert {r.host: r.mean for r in hr.host_reputation(none).collect()} == {"a.com": 0.5, "": 0.5}
    assert hr.host_reputation(df.limit(0)).count() == 0


def test_pages_are_judged(spark):
    rows = [(k % 9 if k % 7 else None, u) for k, u in enumerate(URLS)]
    bad = [f"http://spam.pills.com/de/{k}" for k in range(30)] + ["http://spam.pills.com/en/", "http://www.pills.com/"]
    fine = [f"http://good.news.com/fr/{k}" for k in range(30)] + ["http://good.news.com/en/", "http://www.news.com/"]
    rows += [(100 + k, u) for k, u in enumerate(bad + fine)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    df = df.withColumns({c: F.lit("clash") for c in ("host", "path", "good", "found", "_deal", "html")})
    got = [tuple(r) for r in hr.judged_pages(df, URL_RULES).collect()]
    want, hosts = [], {}
    for page, url in rows:
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        want.append((page, host, path, rule and rule.text))
        hosts.setdefault(host, []).append(rule and rule.verdict == "allow")
    assert sorted((r[:4] for r in got), key=str) == sorted(want, key=str)
    domain, suffix = hr.registered(F.col("host"))
    cut = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain, suffix).collect()
    parents = {r[0]: (r[1], r[2]) for r in cut}
    means = plain_reputation([(h, good) for h, all_ in hosts.items() for good in all_], parents)
    for page, host, path, rule, verdict in got:
        if rule is None:
            assert verdict == ("block" if means[host][2] < 2 / 3 else "allow"), host
        else:
            assert verdict == plain_rule(host, path).verdict
    verdict_of = {(r[1], r[2]): r[4] for r in got}
    assert verdict_of["spam.pills.com", "/en/"] == "block" and verdict_of["good.news.com", "/en/"] == "allow"
    assert hr.judged_pages(df.limit(0), URL_RULES).count() == 0


def test_rules_of_equal_length_go_by_text(spark):
    rules = [hr.Rule("block", "b.a", "/x"), hr.Rule("allow", "a", "/x/y")]
    df = spark.createDataFrame([(1, "http://b.a/x/y")], "page_id long, url string")
    assert hr.judged_pages(df, rules).first().rule == "a/x/y"
