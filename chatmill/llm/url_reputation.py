"""URL filter: fixed rules first, then empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes (1: bad) are counted per host. The bad rate of a host is shrunk towards that of its
registered domain, that towards its suffix, and that towards the whole table: each level is a beta-binomial whose
prior mean is the parent's posterior mean and whose strength is fitted from the spread of the children by moments.
A page is blocked when the lower posterior bound of its host's bad rate reaches a limit.

Null url, or one without "://": host and path are empty; the empty host has a reputation like any other. Null labels
are not counted. With no labels at all the posterior is the prior (mean 1/2, two pseudo-pages), which blocks nothing.
Repeated rows are judged one by one. Clashing extra columns are kept, working names avoid them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.llm.common import fresh, lower_ascii

# fixed values: suffixes of two labels under which names are registered
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "co.in", "co.nz", "com.cn", "com.mx", "co.za", "co.kr")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.lit(getattr(r, field))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def registered_domain(host: Column) -> Column:
    """The suffix and one label before it; ports and user parts are ignored, a bare address stands for itself."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[0-9.]+$|^\[") | (bare == ""), bare).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$|^\["), domain).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def _strength(parent_mean: str, least: float, most: float) -> Column:
    """Pseudo-pages of a level's prior. For a beta-binomial, Var(k/n) = m(1-m)/n * (1 + (n-1) * rho), strength 1/rho - 1."""
    m = F.col(parent_mean)
    spread, n = m * (1 - m), F.col("n")
    rho = F.sum(F.pow(F.col("bad") - n * m, 2) - n * spread) / F.sum(n * (n - 1) * spread)
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(F.when(rho <= 0, F.lit(most)).otherwise(1 / rho - 1), F.lit(most))))


def reputation(pages: DataFrame, outcome: str, url: str = "url", least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(host, n, bad, mean, sd) of every host: the posterior of its bad rate.

    Pages are reduced to one row per host before anything is joined; hosts are then joined with domains, domains with
    suffixes. Strengths are one number per level, worked out over all its members.
    """
    labelled = F.col(outcome).isNotNull()
    hosts = (
        pages.select(host_of(F.col(url)).alias("host"), F.col(outcome).cast("double").alias(outcome))
        .groupBy("host").agg(F.sum(labelled.cast("long")).alias("n"), F.coalesce(F.sum(outcome), F.lit(0.0)).alias("bad"))
        .withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    root = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m_root")).scalar()

    def shrunk(children: DataFrame, parent_mean: str, mean: str) -> DataFrame:
        strength = children.filter("n > 0").agg(_strength(parent_mean, least, most).alias("k")).scalar()
        a = F.col(parent_mean) * F.col("k") + F.col("bad")
        return children.withColumn("k", strength).withColumn("a", a).withColumn("b", F.col("k") + F.col("n") - F.col("a")).withColumn(mean, F.col("a") / (F.col("a") + F.col("b"))).drop("k", parent_mean)

    s = shrunk(suffixes.withColumn("m_root", root), "m_root", "m_suffix").select("suffix", "m_suffix")
    d = shrunk(domains.join(s, "suffix"), "m_suffix", "m_domain").select("domain", "suffix", "m_domain")
    h = shrunk(hosts.join(d, ["domain", "suffix"]), "m_domain", "mean")
    a, b = F.col("a"), F.col("b")
    return h.select("host", "n", "bad", "mean", F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))).alias("sd"))


def judge(pages: DataFrame, rules: list[Rule], outcome: str, url: str = "url", limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` plus host, path, rule, verdict, bad_rate and bad_rate_low; pages keep their number.

    The verdict is that of the longest rule that fits; else ``block`` where the lower bound mean - z * sd of the host's
    bad rate is at least ``limit``. Pages meet the host table in an equi-join that Spark may broadcast when the table
    has proven small, or split where one host is hot.
    """
    host, path, rule, verdict, mean, low = fresh(pages, "host", "path", "rule", "verdict", "bad_rate", "bad_rate_low")
    (its,) = fresh(pages, "_rep_host")
    rep = reputation(pages, outcome, url).select(F.col("host").alias(its), F.col("mean").alias(mean), F.greatest(F.lit(0.0), F.col("mean") - z * F.col("sd")).alias(low))
    with_host = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    joined = with_host.join(rep, F.col(host) == F.col(its), "left").drop(its)
    by_rule = longest_rule(F.col(host), F.col(path), rules, "verdict")
    return joined.withColumns(
        {
            rule: longest_rule(F.col(host), F.col(path), rules, "text"),
            verdict: F.coalesce(by_rule, F.when(F.col(low) >= limit, F.lit("block")).otherwise(F.lit("allow"))),
        }
    )
