"""URL rules, and host reputation by empirical Bayes.

The share of bad pages of a host is a beta-binomial whose prior is centred on
the posterior mean of the registered domain, whose prior in turn is centred on
that of the suffix, and that on the share of bad pages overall.  How strongly
each level pulls is fitted by moments from the counts of that level.  A host
is blocked if a lower posterior bound of its share, by the normal approximation
of the beta posterior, is above a threshold.

Pages are counted by host once; all levels are made from those counts.  A null
url, or one without ``://``, has an empty host and path; urls of any length are
split whole.  The suffix is the last label, or the last two where the last has
two letters and the one before is one of ``SECOND``; the registered domain has
one label more.  Addresses (four numbers, or brackets) are a domain and suffix
of their own.  A host that no labelled page has takes its domain's prior, then
its suffix's, then the overall share.  Labels may be absent altogether: nothing
is blocked then but by rule.  Repeated urls each get the same verdict; repeated
labels count as often; of rules of equal length the first in the list counts;
an empty table gives an empty result.  Columns that have the name of a result
are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import join_counted, refuse, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, start of the path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Labels that are part of the suffix before a country's two letters.
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")

#: Blocked if the bad share is above this, by as many posterior standard deviations.
BAD_SHARE, DEVIATIONS = 0.5, 1.645

#: Pseudo-counts that a prior has at least and at most.
STRENGTH = (1.0, 10_000.0)


def split_url(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds the host, A to Z lower-cased, and the path, both by position alone."""
    refuse(df.columns, (host, path, "_rest"))
    rest = F.when(F.instr(F.col(url), "://") > 0, F.col(url).substr(F.instr(F.col(url), "://") + 3, F.length(url)))
    out = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("_rest", r"\A[^/?#]*", 0)
    out = out.withColumn(host, F.translate(raw, UPPER, LOWER))
    return out.withColumn(path, F.regexp_extract(F.col("_rest").substr(F.length(raw) + 1, F.length("_rest")), r"\A[^?#]*", 0)).drop("_rest")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True)
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, (v, h, p) in reversed(list(zip(fits, ordered, strict=True))):
        name, verdict = F.when(test, h + p).otherwise(name), F.when(test, v).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix; user and port are left out."""
    bare = F.regexp_replace(host, r"\A.*@|:\d*\z", "")
    address = bare.rlike(r"\A(\d+\.){3}\d+\z|\A\[")
    two = bare.rlike(rf"(\A|\.)({'|'.join(SECOND)})\.[a-z]{{2}}\z")

    def last(n: int) -> Column:
        return F.substring_index(bare, ".", -n)

    return F.when(address, bare).when(two, last(3)).otherwise(last(2)), F.when(address, bare).when(two, last(2)).otherwise(last(1))


def _strength(counts: DataFrame, parent: Column) -> float:
    """Pseudo-counts of the prior, by moments: how much more than binomially the counts spread around their parents' shares."""
    n, k = F.col("n"), F.col("bad")
    spread = F.pow(k - n * parent, 2) - n * parent * (1 - parent)
    row = counts.select(F.sum(spread).alias("over"), F.sum(n * (n - 1) * parent * (1 - parent)).alias("scale")).first()
    if not row.scale or not row.over or row.over <= 0:
        return STRENGTH[1]
    rho = min(1.0, row.over / row.scale)  # correlation within a group: 1 / (strength + 1)
    return min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1))


def host_counts(pages: DataFrame) -> DataFrame:
    """A row for each host of rows (host, bad): ``pages`` of it, ``n`` with a label, and the ``bad`` ones; written out."""
    domain, suffix = levels(F.col("host"))
    counts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    return written(counts.withColumn("domain", domain).withColumn("suffix", suffix), F.sum("pages").alias("pages"))


def reputation(counts: DataFrame, deviations: float = DEVIATIONS) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Fits the hierarchy on ``host_counts``: tables of hosts, domains and suffixes with labels, and the overall share.

    Every table has the posterior's ``share`` and ``bound``.  Only sums over
    a level reach the driver.
    """
    hosts = counts.where("n > 0").select("host", "domain", "suffix", "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = ((suffixes.facts["bad"] or 0) + 0.5) / ((suffixes.facts["n"] or 0) + 1)

    def posterior(df: DataFrame, prior: Column, strength: float) -> DataFrame:
        a, b = F.col("bad") + prior * strength, F.col("n") - F.col("bad") + (1 - prior) * strength
        mean = a / (a + b)
        return df.withColumn("share", mean).withColumn("bound", mean - deviations * F.sqrt(mean * (1 - mean) / (a + b + 1))).withColumn("strength", F.lit(strength))

    suffixes = posterior(suffixes, F.lit(overall), _strength(suffixes, F.lit(overall)))
    up = suffixes.select("suffix", F.col("share").alias("_prior"))
    domains = written(domains.join(up, "suffix"))
    domains = posterior(domains, F.col("_prior"), _strength(domains, F.col("_prior"))).drop("_prior")
    up = domains.select("domain", "suffix", F.col("share").alias("_prior"))
    hosts = written(hosts.join(up, ["domain", "suffix"]))
    hosts = posterior(hosts, F.col("_prior"), _strength(hosts, F.col("_prior"))).drop("_prior")
    return hosts, domains, suffixes, overall


def judge(pages: DataFrame, counts: DataFrame, rules=RULES, threshold: float = BAD_SHARE, deviations: float = DEVIATIONS) -> DataFrame:
    """Adds ``rule``, ``verdict`` and ``bad_share`` to pages that ``split_url`` has split.

    ``counts`` has the ``host_counts`` of the same pages with their outcomes.
    A host, domain or suffix without labels is judged by the level above: its
    prior is known, but not the page's host, so only the share counts there.
    """
    refuse(pages.columns, ("rule", "verdict", "bad_share"))
    hosts, domains, suffixes, overall = reputation(counts, deviations)
    seen = counts.select("host", "domain", "suffix", F.col("pages").alias("_n"))
    seen = seen.join(hosts.select("host", F.col("share").alias("_h"), F.col("bound").alias("_hb")), "host", "left")
    seen = seen.join(domains.select("domain", "suffix", F.col("share").alias("_d"), F.col("bound").alias("_db")), ["domain", "suffix"], "left")
    seen = seen.join(suffixes.select("suffix", F.col("share").alias("_s"), F.col("bound").alias("_sb")), "suffix", "left")
    share, bound = F.coalesce("_h", "_d", "_s", F.lit(overall)), F.coalesce("_hb", "_db", "_sb", F.lit(0.0))
    verdicts = written(seen.select("host", "_n", share.alias("bad_share"), F.when(bound > threshold, "block").otherwise("allow").alias("_verdict")))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    told = join_counted(pages, verdicts, "host", counts.facts["pages"] or 0, "left", "path")
    return told.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, F.col("_verdict"))).drop("_verdict")
