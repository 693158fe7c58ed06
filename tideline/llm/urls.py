"""URL filters: rules on host and path, and empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host and path), a bounded list that travels in the plan."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes last and is asked first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


#: Labels under which two-letter countries register names: there a suffix has two labels (co.uk), else one.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (one label more than the suffix) and suffix (the last label, or two by SECOND_LEVEL)."""
    deep = host.rlike(rf"\.({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    last = lambda n: F.substring_index(host, ".", -n)
    return F.when(deep, last(3)).otherwise(last(2)), F.when(deep, last(2)).otherwise(last(1))


def strength(units: DataFrame, mean: float, most: float) -> float:
    """Prior strength by moments: of units (n, bad), how far rates vary beyond counting; 1 to most, most if they don't."""
    r = units.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("q")
    ).first()
    if not r["n"]:
        return most
    squares, free, spread = r["q"] - r["n"] * mean * mean, r["k"] - 1, r["n"] - r["n2"] / r["n"]
    between = (squares - free * mean * (1 - mean)) / (spread - free) if spread > free else 0.0
    return most if between <= 0 else min(most, max(1.0, mean * (1 - mean) / between - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, max_bad: float = 0.5, z: float = 1.645, most: float = 1000.0) -> DataFrame:
    """host, its labelled pages n, posterior mean and lower bound of its rate of bad pages, and blocked.

    pages: page_id, host; outcomes: page_id, bad (boolean). Rates shrink level by level: a suffix to the rate of
    all labelled pages, a registered domain to its suffix, a host to its domain; each level's beta prior has the
    mean above it and a strength fitted by moments. A host is blocked if the posterior's lower bound
    (mean - z deviations) is over max_bad, so few outcomes never block. Counts combine before each shuffle.
    Several outcomes of one page all count; null outcomes don't.
    """
    labelled = pages.select("page_id", "host").join(outcomes.where("bad IS NOT NULL").select("page_id", "bad"), "page_id", "left")
    domain, suffix = levels(F.col("host"))
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    hosts = common.written(hosts.withColumns({"domain": domain, "suffix": suffix}), "host-outcomes")
    up = lambda df, *by: common.written(df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "host-level")
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    all_ = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = all_["bad"] / all_["n"] if all_["n"] else 0.0
    k3, k2, k1 = (strength(x, mean, most) for x in (suffixes, domains, hosts))
    shrunk = lambda prior, k: (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), k3).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_rate"), k2).alias("domain_rate"))
    m, total = F.col("rate"), F.col("n") + F.lit(k1) + 1
    rated = hosts.join(domains, "domain").select("host", "n", "bad", shrunk(F.col("domain_rate"), k1).alias("rate"))
    return rated.withColumn("low", m - z * F.sqrt(m * (1 - m) / total)).withColumn("blocked", F.col("low") > max_bad)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block: the longest rule's, else the host's reputation's).

    Null urls, and those without ://, have empty host and path, fit no rule, and share the reputation of the
    empty host. Null page_ids have no outcome. Repeated rows are kept and counted. Empty tables stay empty.
    Columns of pages with those names are replaced; others pass through, whatever they are called. Only blocked hosts are joined back.
    """
    columns = common.without(pages.columns, "host", "path", "rule", "verdict")
    host, path = split_url(F.col("url"))
    parsed = common.as_row(pages, F.col("page_id"), host.alias("host"), path.alias("path"))
    reputation = host_reputation(parsed, outcomes, max_bad, z)
    blocked = common.written(reputation.where("blocked").select("host", F.lit("block").alias("blocked")), "hosts-blocked")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "by_rule": verdict}).join(blocked, "host", "left")
    return judged.select(*common.row_columns(columns), "host", "path", "rule", F.coalesce("by_rule", "blocked", F.lit("allow")).alias("verdict"))
