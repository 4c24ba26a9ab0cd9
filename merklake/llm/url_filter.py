"""Judgement of urls: rules first, then the reputation of the host by empirical Bayes.

Outcomes of labelled pages (good or not) are counted by host, registered domain and suffix. The rate of bad pages at each
level has a beta prior around the posterior mean of the level above (suffixes: around the overall rate); the strength of
the priors of a level comes from how far the rates of its groups spread beyond chance (method of moments, over all groups).
So a host with few labels is taken for what its domain is, and a domain for its suffix. A url is blocked when the lower
posterior bound of its host's rate of bad pages (mean less `bound` standard deviations) is over `limit`.

Counts are summed before the shuffle, and the result joins pages and hosts, which adaptive execution may split, so a host
may have any share of the pages. Null urls and urls without `://` have an empty host and path and are judged by what is
known of such. Null outcomes, and outcomes of null ids, are left out; an id with several counts as bad when one is. Input
columns named like the results are replaced, others may have any name; repeated rows are judged each; empty tables give empty ones.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merklake.llm.words import unused
from merklake.sources.scratch import materialize

LIMIT, BOUND = 0.5, 1.645
# Suffixes of two labels under which domains are registered.
DOUBLE_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "com.br", "com.cn", "co.in", "co.za"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name and verdict of the longest rule that fits, or null. The rules are a short list, written into the plan."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _levels(host: Column) -> list[Column]:
    """Suffix and registered domain of a host, without port and user."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    two, three = F.array_join(F.slice(labels, -2, 2), "."), F.array_join(F.slice(labels, -3, 3), ".")
    numeric = name.rlike(r"^[0-9.]+$")
    double = two.isin(DOUBLE_SUFFIXES) & (F.size(labels) > 2)
    suffix = F.when(numeric | (F.size(labels) < 2), F.lit("")).when(double, two).otherwise(F.element_at(labels, -1))
    domain = F.when(numeric | (F.size(labels) < 3), name).when(double, three).otherwise(two)
    return [suffix.alias("suffix"), domain.alias("domain")]


def _strength() -> Column:
    """Prior strength from n, bad and prior (the mean of the level above): the excess spread of rates, between 1 and 1,000."""
    p, rate = F.col("prior"), F.col("bad") / F.col("n")
    spread, chance = F.sum(F.col("n") * (rate - p) ** 2), F.sum(p * (1 - p))
    whole = F.sum(F.col("n") * p * (1 - p))
    excess = (spread - chance) / F.nullif(whole - chance, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / F.nullif(F.greatest(excess, F.lit(0.0)), F.lit(0.0)) - 1)), F.lit(1000.0))


def reputations(hosts: DataFrame) -> DataFrame:
    """host and bad_bound from host, n, bad (labelled pages and bad ones among them; every host once)."""
    hosts = hosts.select("host", *_levels(F.col("host")), F.col("n").cast("double"), F.col("bad").cast("double"))
    overall = hosts.agg((F.sum("bad") + 0.5) / (F.sum("n") + 1)).first()[0]

    def posterior(groups: DataFrame, above: DataFrame | None, key: str, *upper: str) -> DataFrame:
        known = groups.withColumn("prior", F.lit(overall).cast("double")) if above is None else groups.join(above, list(upper))
        strength = F.lit(known.where("n > 0").agg(_strength()).first()[0])  # one number for the level
        return known.select(
            key, *upper,
            (F.col("prior") * strength + F.col("bad")).alias("a"), ((1 - F.col("prior")) * strength + F.col("n") - F.col("bad")).alias("b"),
        )

    def mean(level: DataFrame, *keys: str) -> DataFrame:
        return level.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))

    def sums(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    suffixes = mean(posterior(sums("suffix"), None, "suffix"), "suffix")
    domains = mean(posterior(sums("domain", "suffix"), suffixes, "domain", "suffix"), "domain", "suffix")
    own = posterior(hosts, domains, "host", "domain", "suffix")  # as a domain may have two suffixes: 1.2 alone is a number
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return own.select("host", (F.col("a") / total - BOUND * deviation).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `pages` (page_id, url, ...; all by default), and host, path, rule, verdict, bad_bound.

    outcomes: page_id, good (boolean).
    """
    results = ["host", "path", "rule", "verdict", "bad_bound"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in results]
    rows = pages.select(*keep, host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    fits = unused("_rule", keep)
    known = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.max((~F.col("good")).cast("int")).alias("_bad"))
    seen = pages.select("page_id", host_of(pages["url"]).alias("host")).join(known, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    rows = rows.join(reputations(materialize(hosts, "hosts")), "host").withColumn(fits, matching_rule(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bad_bound") > LIMIT, "block").otherwise("allow")
    return rows.select(*keep, "host", "path", F.col(fits)["rule"].alias("rule"), F.coalesce(F.col(fits)["verdict"], by_host).alias("verdict"), "bad_bound")
