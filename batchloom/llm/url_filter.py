"""URL filter: rules first, then the reputation of the host.

The reputation is the rate of bad pages, from labelled pages, shrunk from level
to level. Public suffix, registered domain and host (without user and port) form a tree; a node's prior
is a beta distribution around its parent's mean, worth ``strength`` pages:

    mean(node) = (bad(node) + strength * mean(parent)) / (n(node) + strength)

starting from the rate of all labelled pages. ``strength`` is estimated for each
level from the spread of the children around their parents (method of moments),
and is at most the number of pages behind the parent's mean.
A host is blocked when the lower bound of its posterior, mean - z * deviation,
exceeds ``max_bad_rate``: a host with few labels has a wide posterior and passes.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by no rule; the empty host is a host like any other. An address is its own suffix,
domain and host, so addresses share no prior but the rate of all pages. A host without
labels has its domain's posterior mean, hence is allowed unless that is certain.
Null labels count as not bad; rows of equal ids are judged one by one.
An empty table of labels blocks nothing; an empty table of pages gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import stored

# (action, host, start of the path)
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
LEVELS = ["suffix", "domain", "site"]
# Suffixes below the last label that take registrations; fixed values. A star stands
# for any one label, an exclamation mark takes a name out of it. Pass a full list of
# public suffixes as ``suffixes`` where the hosts of the world are judged.
SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "com.cn", "co.in", "co.kr",
    "co.nz", "co.za", "com.mx", "com.tr", "com.tw", "*.ck", "!www.ck",
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(site: Column, suffixes: Sequence[str] = tuple(SUFFIXES)) -> Column:
    """Public suffix by the longest rule; the last label if none fits; an address, itself."""
    apart = {s[1:] for s in suffixes if s.startswith("!")}
    stars = {s[2:] for s in suffixes if s.startswith("*.")}
    names = {s for s in suffixes if s[0] not in "!*"}
    most = max([s.lstrip("!").count(".") + 1 for s in suffixes], default=1)

    def last(labels: int) -> Column:
        return F.substring_index(site, ".", -labels)

    out = last(1)
    for n in range(2, most + 1):
        long_enough = F.size(F.split(site, r"\.")) >= n
        out = F.when(long_enough & (last(n).isin(*names) | last(n - 1).isin(*stars)), last(n)).otherwise(out)
    for n in range(2, most + 1):
        out = F.when(last(n).isin(*apart), last(n - 1)).otherwise(out)
    return F.when(site.rlike(r"^([0-9]+\.){3}[0-9]+$|^\["), site).otherwise(out)


def domain_of(site: Column, suffix: Column) -> Column:
    """The suffix and one label more; a site that is no longer than that, itself."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(site, r"\.")
    return F.when((F.size(parts) <= labels) | (site == suffix), site).otherwise(
        F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), ".")
    )


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits columns ``host`` and ``path``."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        host = F.col("host")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & F.col("path").startswith(start)
        name = F.when(fits, rule_host + start).otherwise(name)
        action = F.when(fits, act).otherwise(action)
    return name, action


def parsed(pages: DataFrame, suffixes: Sequence[str] = tuple(SUFFIXES)) -> DataFrame:
    """Page ids with host, path, and the levels: suffix, registered domain, site."""
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("site", site_of(F.col("host")))
    out = out.withColumn("suffix", suffix_of(F.col("site"), suffixes))
    return out.withColumn("domain", domain_of(F.col("site"), F.col("suffix")))


def page_outcomes(pages: DataFrame, labels: DataFrame, suffixes: Sequence[str] = tuple(SUFFIXES)) -> DataFrame:
    """Labelled pages: levels of the host, and ``bad`` 0 or 1.

    The label of a page is that of the document with its id; low quality or
    toxic counts as bad.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    return parsed(pages, suffixes).join(marks, "page_id").select(*LEVELS, "bad")


def reputation(outcomes: DataFrame, hosts: DataFrame, max_strength: float = 1000.0) -> DataFrame:
    """Posterior mean and deviation of the bad rate, for each of ``hosts``.

    Labelled pages are added up per host before any shuffle; what follows works
    on one row per host, domain or suffix. These and the counts of each level are
    written once, as the strength of a level is a figure of all its rows.
    """
    per_host = outcomes.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    nodes = hosts.select(*LEVELS).distinct().join(per_host, LEVELS, "left").fillna(0, ["n", "bad"])
    nodes = stored(nodes, "reputation-nodes")
    rate = (F.sum("bad") + 1.0) / (F.sum("n") + 2.0)
    root = nodes.agg(F.struct(rate.alias("mean"), (F.coalesce(F.sum("n"), F.lit(0)) + 2.0).alias("weight")).alias("root")).scalar()
    parents, keys = None, []
    for level in LEVELS:
        keys = [*keys, level]
        counts = nodes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if parents is None:
            at = counts.withColumn("prior", F.coalesce(root["mean"], F.lit(0.5))).withColumn("behind", root["weight"])
        else:
            at = counts.join(parents, keys[:-1])
        at = stored(at, f"reputation-{level}")
        # Var(bad/n) = m(1-m)/n * (1 + (n-1) * rho); rho = 1 / (strength + 1).
        spread = F.col("prior") * (1 - F.col("prior"))
        seen = F.col("n") >= 2
        excess = F.sum(F.when(seen, (F.col("bad") - F.col("n") * F.col("prior")) ** 2 / F.col("n") - spread))
        pairs = F.sum(F.when(seen, spread * (F.col("n") - 1)))
        rho = at.agg((excess / pairs).alias("rho")).scalar()
        bounded = F.greatest(F.lit(1.0 / (max_strength + 1)), F.least(F.coalesce(rho, F.lit(0.0)), F.lit(0.5)))
        # A prior is not worth more pages than there are behind its mean.
        strength = F.least(1.0 / bounded - 1.0, F.col("behind"))
        weight = F.col("n") + F.col("strength")
        mean = (F.col("bad") + F.col("strength") * F.col("prior")) / weight
        at = at.withColumn("strength", strength).select(*keys, mean.alias("mean"), weight.alias("weight"))
        parents = at.select(*keys, F.col("mean").alias("prior"), F.col("weight").alias("behind"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return at.select("site", "mean", deviation.alias("deviation"))


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = tuple(RULES),
    max_bad_rate: float = 0.25,
    z: float = 1.645,
    suffixes: Sequence[str] = tuple(SUFFIXES),
) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, and the posterior.

    Hosts are joined back by name; the side of the hosts has one row per host,
    so a host with a third of all pages can be split.
    """
    urls = parsed(pages, suffixes)
    known = reputation(page_outcomes(pages, labels, suffixes), urls)
    rule, action = rule_columns(rules)
    lower = F.col("mean") - z * F.col("deviation")
    verdict = F.coalesce(action, F.when(lower > max_bad_rate, "block").otherwise("allow"))
    return urls.join(known, "site").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("mean").alias("bad_rate"), lower.alias("lower_bound")
    )
