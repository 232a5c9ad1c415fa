"""Operator 4: URL filter by rules and by empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host. Each level of the name (host, registered domain, suffix) is a beta-binomial
population around its parent's posterior mean; how far members scatter is estimated from the excess of their squared deviations
over the binomial ones. A host's posterior shrinks towards its domain, the domain towards its suffix, the suffix towards
the mean of all. A page passes if the posterior mean less ``z`` standard deviations reaches ``floor``.

Everything but three estimated numbers stays in tables; a level is aggregated from the one below, with map-side sums, so a
host with a third of all pages is one row afterwards. All steps are DataFrame expressions.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged as host ''. A host without labelled
pages gets its domain's posterior as prior. Outcomes that are null count for nothing; repeated ones count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import lower_ascii, stored

# Public suffixes of two labels under which names are registered (fixed values).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "or.jp", "org.au", "org.uk")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    there = F.coalesce(at > 0, F.lit(False))
    return F.when(there, lower_ascii(host)).otherwise(""), F.when(there, path).otherwise("")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``, verdict) that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def _strength(members: DataFrame) -> float:
    """Prior sample size of a level, from rows n, k and the parent's mean m."""
    p = F.col("k") / F.col("n")
    excess = F.col("n") * (p - F.col("m")) * (p - F.col("m")) / (F.col("m") * (1 - F.col("m")))
    row = (
        members.filter((F.col("n") > 0) & (F.col("m") > 0) & (F.col("m") < 1))
        .agg(F.sum(excess).alias("s"), F.count("*").alias("i"), F.sum("n").alias("n"))
        .first()
    )
    if row["s"] is None or row["n"] <= row["i"]:
        return 9.0
    spread = (row["s"] - row["i"]) / (row["n"] - row["i"])
    return 1 / min(0.9, max(1e-3, spread)) - 1


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host of ``outcomes`` (host string, good boolean or null): n, k, and its posterior's mean and lower bound."""
    good = F.col("good").cast("int")
    hosts = stored(
        outcomes.groupBy("host")
        .agg(F.count(good).alias("n"), F.coalesce(F.sum(good), F.lit(0)).cast("long").alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host"))),
        "hosts",
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    # One good and one bad page are added to all, so the mean lies within 0 and 1 and exists for no labels at all.
    mean = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)

    def level(rows: DataFrame) -> DataFrame:
        strength = _strength(rows)
        return rows.withColumn("mean", (F.col("k") + strength * F.col("m")) / (F.col("n") + strength)).withColumn(
            "strength", F.lit(strength)
        )

    suffixes = level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(mean)))
    domains = level(
        hosts.groupBy("suffix", "domain")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix")
    )
    out = level(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"))
    size = F.col("n") + F.col("strength")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return out.select("host", "n", "k", "mean", (F.col("mean") - z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], floor: float = 0.5, url: str = "url") -> DataFrame:
    """Pages with host, path, rule, bound and verdict. Columns of those names are replaced; all others pass through."""
    host, path = url_parts(F.col(url))
    rows = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict", "bound")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    known = reputations(outcomes).select("host", "bound")
    passes = F.when(F.col("bound") >= floor, "allow").otherwise("block")
    return rows.join(known, "host", "left").withColumns({"rule": rule, "verdict": F.coalesce(verdict, passes)})
