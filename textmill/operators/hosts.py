"""Host names: normal form, suffix join, compaction of lists, scan policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def normal_host(text: Column) -> Column:
    """Lower case, without scheme, path, port and www; null if it isn't a host name."""
    h = F.regexp_replace(F.lower(F.trim(text)), r"^[a-z][a-z0-9+.-]*://|^\*\.", "")
    h = F.regexp_replace(F.regexp_replace(h, r"[/?#:].*$", ""), r"^www\.|\.$", "")
    return F.when(h.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"), h)


def homepage(url: Column) -> Column:
    """Whether the path is that of a start page."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return path.rlike(r"^/?$|^/(index\.[a-z]+|[a-z]{2}(-[a-z]{2})?)/?$")


def suffixes(host: Column, own: bool = True, least: int = 1) -> Column:
    """The host itself (if own) and its parent domains of `least` labels or more, longest first."""
    parts = F.split(host, r"\.")
    last = F.size(parts) - (least - 1)
    first = 1 if own else 2
    at = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def suffix_match(hosts: DataFrame, sites: DataFrame, least: int = 1) -> DataFrame:
    """(host, site): for each distinct host the longest site that it equals or lies under; an equi join of its suffixes."""
    h = hosts.select("host").distinct().select("host", F.explode(suffixes(F.col("host"), least=least)).alias("site"))
    got = h.join(sites.select("site").distinct(), "site")
    return got.groupBy("host").agg(F.max_by("site", F.length("site")).alias("site"))


def compact(domains: DataFrame) -> DataFrame:
    """(domain): distinct domains whose parents (of two labels or more) aren't listed."""
    d = domains.select("domain").distinct()
    under = d.select("domain", F.explode(suffixes(F.col("domain"), own=False, least=2)).alias("parent"))
    return d.join(under.join(d.select(F.col("domain").alias("parent")), "parent").select("domain"), "domain", "left_anti")


def contributions(domains: DataFrame, sources: list[str]) -> DataFrame:
    """(source, n, added): the size of the compacted list of all sources up to this one, less that before it."""
    order = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    d = domains.withColumn("k", order)
    # a domain is in prefix p if some source up to p has it, and covered if some parent's source is
    first = d.groupBy("domain").agg(F.min("k").alias("k"))
    under = first.select("domain", F.explode(suffixes(F.col("domain"), own=False, least=2)).alias("parent"))
    gone = under.join(first.select(F.col("domain").alias("parent"), F.col("k").alias("pk")), "parent").groupBy("domain").agg(F.min("pk").alias("pk"))
    life = first.join(gone, "domain", "left").select("k", "pk")
    life = life.filter(F.col("pk").isNull() | (F.col("pk") > F.col("k")))
    steps = life.select(F.col("k").alias("p"), F.lit(1).alias("d")).union(life.filter("pk IS NOT NULL").select("pk", F.lit(-1)))
    added = steps.groupBy("p").agg(F.sum("d").alias("added"))
    count = d.groupBy("source", "k").agg(F.count_distinct("domain").alias("n"))
    return count.join(added, count["k"] == added["p"], "left").select("source", "n", F.coalesce("added", F.lit(0)).cast("long").alias("added"))


def policies(hosts: DataFrame, blocked: DataFrame, builtin: DataFrame, unblocked: DataFrame, sites: DataFrame, mode: str, enabled: bool = True) -> DataFrame:
    """(host, reason, policy): own entries block before the bundled list, exceptions lift the bundled list only."""
    mark = lambda df, name, least=1: suffix_match(hosts, df, least).select("host", F.col("site").alias(name))
    h = hosts.select("host").distinct()
    for df, name, least in ((blocked, "own", 1), (builtin, "listed", 2), (unblocked, "lifted", 1), (sites, "chosen", 1)):
        h = h.join(mark(df, name, least), "host", "left")
    reason = F.when(F.col("own").isNotNull(), "user").when(F.col("listed").isNotNull() & F.col("lifted").isNull(), "builtin")
    auto = F.lit(mode == "all") | (F.lit(mode == "sites") & F.col("chosen").isNotNull())
    policy = F.when(F.lit(not enabled), "off").when(reason.isNotNull(), "blocked").when(auto, "auto").otherwise("manual")
    return h.select("host", reason.alias("reason"), policy.alias("policy"))
