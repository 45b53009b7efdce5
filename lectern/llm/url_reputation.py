"""URL filter: explicit rules, else an empirical-Bayes reputation of the host.

A rule names a host and a path prefix; it fits the host and its subdomains,
and the longest rule that fits decides.  Pages that a rule decides are the
labelled outcomes (allow: good).  Their rates are shrunk from level to level:
the overall rate is the prior mean of a suffix, the suffix's posterior mean
that of a registered domain, the domain's that of a host.  The strength of
each level's beta prior is estimated by the method of moments from how much
the rates of the level vary beyond binomial noise.  A page without a rule is
blocked when the upper posterior bound of its host's rate of good pages lies
below ``min_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_GOOD = 0.5
BOUND_Z = 1.64             # posterior standard deviations above the mean
STRENGTHS = (1.0, 1000.0)  # least and largest weight of a prior, in pages


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed by the task.
RULES = (
    Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True), Rule("com", "/de/", False),
)


def host_of(url: Column) -> Column:
    """Authority of an absolute URL, A-Z in lower case; empty without one."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the authority up to ``?`` or ``#``; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def labelled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, allow) of the longest rule that fits, NULL if none does; of rules
    of one length the last by text, of equal rules the one that allows."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text, not r.allow)):
        fit = fits(rule, host, path)
        text, allow = F.when(fit, rule.text).otherwise(text), F.when(fit, rule.allow).otherwise(allow)
    return text, allow


def suffix_of(host: Column) -> Column:
    """Last label of a host, such as ``com``."""
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """Last two labels, such as ``example.com``."""
    return F.substring_index(host, ".", -2)


def strength() -> Column:
    """Prior strength from a level's (n, good, mean) rows by moments: binomial
    noise explains part of the squared deviations, the rest is the beta's."""
    deviation = F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("mean")) * (F.col("good") / F.col("n") - F.col("mean")))
    noise = F.sum(F.col("mean") * (1 - F.col("mean")))
    total = F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean")))
    between = (deviation - noise) / F.greatest(total - noise, F.lit(1e-9))
    estimate = F.when(between <= 0, STRENGTHS[1]).otherwise((1 - between) / between)
    return F.coalesce(F.least(F.greatest(estimate, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1])), F.lit(STRENGTHS[1]))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, alpha, beta): the posterior of every host in ``outcomes``, rows of
    (host, n, good); hosts with n = 0 get their domain's posterior mean, and
    without any outcome the prior mean is 1/2."""
    hosts = outcomes.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(((F.sum("good") + 0.5) / (F.sum("n") + 1.0)).alias("mean"))

    def shrink(level: DataFrame) -> DataFrame:
        """Posterior (alpha, beta) of rows (n, good, mean)."""
        s = level.filter("n > 0").agg(strength().alias("s")).scalar()
        out = level.withColumn("s", s)
        return out.select(*[c for c in level.columns if c not in ("n", "good", "mean")],
                          (F.col("mean") * F.col("s") + F.col("good")).alias("alpha"),
                          ((1 - F.col("mean")) * F.col("s") + F.col("n") - F.col("good")).alias("beta"))

    mean = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean")
    top = shrink(suffixes.withColumn("mean", overall.scalar())).select("suffix", mean)
    middle = shrink(domains.join(top, "suffix")).select("domain", mean)
    return shrink(hosts.join(middle, "domain")).select("host", "alpha", "beta")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, min_good: float = MIN_GOOD, z: float = BOUND_Z,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, good_upper) of every row.

    ``good_upper`` is the host's upper posterior bound.  A NULL URL and one
    without ``://`` have an empty host and path; such pages share the
    reputation of the empty host.  Repeated rows count and stay.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, allow = labelled(F.col("host"), F.col("path"), rules)
    ruled = parts.select("id", "host", "path", text.alias("rule"), allow.alias("allow"))
    outcomes = ruled.groupBy("host").agg(F.count("allow").alias("n"), F.count(F.when(F.col("allow"), 1)).alias("good"))
    a, b = F.col("alpha"), F.col("beta")
    upper = a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    bounds = reputations(outcomes).select(F.col("host").alias("of"), F.round(upper, 9).alias("good_upper"))
    joined = ruled.join(bounds, F.col("host") == F.col("of"), "left")
    verdict = F.when(F.coalesce("allow", F.col("good_upper") >= min_good), "allow").otherwise("block")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "good_upper")
