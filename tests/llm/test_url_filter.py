import re
from collections import Counter

import pytest

from merklake.llm import queries
from merklake.llm.url_filter import Rule, host_of, judge, path_of, reputations

OUTCOMES = "page_id bigint, good boolean"
URLS = [None, "", "no scheme", "http://", "https://A.Example.NET:80/En/x?y#z", "x://a://b/c", "http://h?q/r", "http://h#f/r", "http://ÀB.com/\n/p", "http://net/", "http://net", "http://xnet/", "http://a.net/p"]


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def best_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = judge(pages, spark.createDataFrame([], OUTCOMES), queries.URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in got] == [parts(u) for u in URLS]
    for r in got:
        rule = best_rule(r.host, r.path, queries.URL_RULES)
        assert (r.rule, r.verdict) == ((rule.name, rule.verdict) if rule else (None, "allow"))
    assert [r.x for r in pages.select(host_of(pages.url).alias("x")).where("url is null or url = ''").collect()] == ["", ""]
    assert pages.select(path_of(pages.url).alias("x")).where("x is null").count() == 0
    assert judge(pages.limit(0), spark.createDataFrame([], OUTCOMES), []).count() == 0


def brute_bounds(hosts):
    """Posterior bounds in plain Python, of {host: (n, bad)} with hosts of three labels."""

    def posterior(groups, prior):
        known = [(n, bad, prior[k]) for k, (n, bad) in groups.items() if n]
        spread, chance = sum(n * (b / n - p) ** 2 for n, b, p in known), sum(p * (1 - p) for _, _, p in known)
        whole = sum(n * p * (1 - p) for n, _, p in known)
        excess = max(0.0, (spread - chance) / (whole - chance)) if whole != chance else 0.0
        strength = max(1.0, min(1000.0, 1 / excess - 1)) if excess else 1000.0
        return {k: (prior[k] * strength + bad, (1 - prior[k]) * strength + n - bad) for k, (n, bad) in groups.items()}

    def summed(cut):
        out = {}
        for h, (n, b) in hosts.items():
            x = out.get(cut(h), (0, 0))
            out[cut(h)] = (x[0] + n, x[1] + b)
        return out

    n, bad = map(sum, zip(*hosts.values(), strict=True))
    suffix = summed(lambda h: h.split(".")[-1])
    domain = summed(lambda h: ".".join(h.split(".")[-2:]))
    s = {k: a / (a + b) for k, (a, b) in posterior(suffix, dict.fromkeys(suffix, (bad + 0.5) / (n + 1))).items()}
    d = {k: a / (a + b) for k, (a, b) in posterior(domain, {k: s[k.split(".")[-1]] for k in domain}).items()}
    own = posterior(hosts, {h: d[".".join(h.split(".")[-2:])] for h in hosts})
    return {h: a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 for h, (a, b) in own.items()}


def test_reputation_against_brute_force(spark):
    hosts = {f"h{i}.{d}.{s}": (i * 7 % 40, (i * 7 % 40) * (i % 4) // 4) for i in range(12) for d in ("aa", "bb") for s in ("com", "org")}
    hosts |= {f"x{i}.spam.biz": (20, 20) for i in range(3)} | {"new.spam.biz": (0, 0)}
    table = spark.createDataFrame([(h, n, b) for h, (n, b) in hosts.items()], "host string, n bigint, bad bigint")
    got = {r.host: r.bad_bound for r in reputations(table).collect()}
    assert got == pytest.approx(brute_bounds(hosts))
    assert got["x1.spam.biz"] > 0.5 and got["h0.aa.com"] < 0.5


def test_blocked_hosts(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.d{i % 2}.com/{i}") for i in range(200)] + [(0, "http://bad.d1.com/again")]
    pages = spark.createDataFrame(pages, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(100)] + [(None, False), (4, None), (2, False), (2, True)], OUTCOMES)
    got = Counter((r.host, r.verdict) for r in judge(pages, labels, [Rule("allow", "bad.d1.com", "/199")]).collect())
    assert got == {("bad.d1.com", "block"): 100, ("bad.d1.com", "allow"): 1, ("good.d0.com", "allow"): 100}


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op9_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path) == parts(pages[r.page_id])
        rule = best_rule(r.host, r.path, queries.URL_RULES)
        assert r.rule == (rule.name if rule else None) and r.verdict == (rule.verdict if rule else r.verdict)
