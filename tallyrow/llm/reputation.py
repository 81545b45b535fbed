"""URL filter: hand-written host rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain and public suffix. Each level is shrunk
towards the one above through a beta prior whose weight is fitted by the method of moments:

    suffix mean  = (bad + w * overall) / (n + w),
    domain mean  = (bad + w * suffix mean) / (n + w),
    host         ~ Beta(bad + w * domain mean, n - bad + w * (1 - domain mean)).

A page without a rule is blocked if the lower bound of its host's posterior bad rate exceeds ``limit``; hosts
without labelled pages have the posterior of their domain, else of their suffix.
Everything is DataFrame expressions. Counts are aggregated before they are joined; one host may hold any share
of the pages, as the join's other side has one row a host and Spark may split the pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table
from tallyrow.session import materialize

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Without a list of suffixes: a general label below a country's code is a suffix (``co.uk``, ``com.br``).
PAIRED_SUFFIX = r"(?:^|\.)((?:ac|co|com|ed|edu|gob|go|gouv|gov|ltd|me|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2})$"
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


@dataclass(frozen=True)
class Rule:
    """``rule`` is a host and a path joined (``net/es/``); it fits the host and its subdomains."""

    verdict: str
    rule: str


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """The host under which a page is counted: without user, port and the dots at its ends."""
    bare = F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", "")
    return F.trim(bare, F.lit("."))


def suffix_of(key: Column) -> Column:
    """The public suffix by rule; an address is its own suffix."""
    two = F.regexp_extract(key, PAIRED_SUFFIX, 1)
    return F.when(key.rlike(ADDRESS), key).when(two != "", two).otherwise(F.substring_index(key, ".", -1))


def domain_of(key: Column, suffix: Column) -> Column:
    """The suffix with the label before it, where there is one."""
    rest = F.substring(key, F.lit(1), F.length(key) - F.length(suffix) - 1)
    return F.when(F.length(key) <= F.length(suffix) + 1, key).otherwise(F.concat_ws(".", F.substring_index(rest, ".", -1), suffix))


def with_levels(keys: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to the distinct values of ``key``.

    ``suffixes`` has one column ``suffix`` of rules as public lists state them: ``co.uk``, ``*.ck`` (any label below)
    and ``!www.ck`` (not a suffix although the one before says so). The rule with the most labels counts, an exception
    before all; a key that fits none, and an address, are taken as without a list. Each key meets the list by an
    equi-join on its tails.
    """
    keys = keys.withColumn("suffix", suffix_of(F.col("key")))
    if suffixes is not None:
        parts = F.split("key", r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
        tail = F.col("tail")
        below = F.regexp_replace(tail, r"^[^.]*\.", "")  # the tail without its first label
        rules = F.array(
            F.struct(F.concat(F.lit("!"), tail).alias("rule"), F.lit(2).alias("kind"), below.alias("is")),
            F.struct(F.concat(F.lit("*."), below).alias("rule"), F.lit(1).alias("kind"), tail.alias("is")),
            F.struct(tail.alias("rule"), F.lit(1).alias("kind"), tail.alias("is")),
        )
        asked = keys.where(~F.col("key").rlike(ADDRESS)).select("key", F.explode(tails).alias("tail")).select("key", F.explode(rules).alias("r"))
        listed = suffixes.select(F.trim(F.lower("suffix")).alias("rule")).where("rule != ''").distinct()
        longest = F.max_by("r.is", F.struct("r.kind", F.length("r.is")))
        found = asked.join(listed, F.col("r.rule") == F.col("rule")).groupBy("key").agg(longest.alias("listed"))
        keys = keys.join(found, "key", "left").withColumn("suffix", F.coalesce("listed", "suffix")).drop("listed")
    return keys.withColumn("domain", domain_of(F.col("key"), F.col("suffix")))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does; ties go to the first one given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.rule)):
        at, _, below = rule.rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        name, verdict = F.when(fits, rule.rule).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _weight(level: DataFrame, mean: str) -> Column:
    """Aggregate: the prior weight that explains how the rates spread around ``mean``, by moments."""
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    expected = F.col(mean) * (1 - F.col(mean))
    spread = F.sum(n * (rate - F.col(mean)) ** 2)
    # E[n (rate - m)^2] = m (1 - m) (n + w) / (1 + w); solve its sum over the groups for w
    top = F.sum(expected * n) - spread
    weight = F.when(spread > F.sum(expected), top / (spread - F.sum(expected))).otherwise(MOST_WEIGHT)
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(weight, F.lit(MOST_WEIGHT))))


def _shrunk(level: DataFrame, prior: str, name: str) -> DataFrame:
    """Adds ``name``: the level's rates shrunk to the column ``prior``."""
    weight = level.agg(_weight(level, prior).alias("w")).first()["w"]
    return level.withColumn(name, (F.col("bad") + weight * F.col(prior)) / (F.col("n") + weight)).withColumn("w", F.lit(weight))


def reputation(outcomes: DataFrame, z: float = 1.64, suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posteriors by host, domain and suffix as (key, mean, bound), and the bound where nothing is known.

    ``outcomes`` has (host, bad) with bad 0 or 1; rows with a null are ignored. Hosts are counted by :func:`key_of`,
    in a table that is written once.
    """
    seen = outcomes.select(key_of(F.col("host")).alias("key"), "bad").where(F.col("key").isNotNull() & (F.col("key") != "") & F.col("bad").isNotNull())
    counted = materialize(seen.groupBy("key").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    hosts = counted.join(with_levels(counted.select("key"), suffixes), "key") if suffixes is not None else with_levels(counted)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] + 1.0) / (total["n"] + 2.0) if total["n"] else 0.5

    def bound(level: DataFrame, key: str, mean: str) -> DataFrame:
        size = F.col("n") + F.col("w")
        sd = F.sqrt(F.col(mean) * (1 - F.col(mean)) / (size + 1))
        return level.select(F.col(key), F.col(mean).alias("mean"), F.greatest(F.lit(0.0), F.col(mean) - z * sd).alias("bound"))

    suffixes = _shrunk(suffixes.withColumn("prior", F.lit(overall)), "prior", "suffix_mean")
    domains = _shrunk(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "suffix_mean", "domain_mean")
    hosts = _shrunk(hosts.join(domains.select("domain", "domain_mean"), "domain"), "domain_mean", "host_mean")
    unknown = max(0.0, overall - z * (overall * (1 - overall) / 2) ** 0.5)
    return bound(hosts, "key", "host_mean"), bound(domains, "domain", "domain_mean"), bound(suffixes, "suffix", "suffix_mean"), unknown


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = 0.5, z: float = 1.64, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) for every row.

    A null url, or one without ``://``, has an empty host and path; no rule fits it and it is allowed unless the
    overall bound is above ``limit``. Repeated rows are judged one by one, null ids are kept, other columns are
    ignored. Without outcomes every bound is that of an even prior. ``host`` is as the url has it; reputation goes by
    :func:`key_of`, and by the rules in ``suffixes`` where given (:func:`with_levels`).
    """
    hosts, domains, by_suffix, unknown = reputation(outcomes, z, suffixes)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # bounds per distinct host first, so that the pages are joined once
    known = with_levels(rows.select(key_of(F.col("host")).alias("key")).distinct(), suffixes)
    # written, so that the join's both sides come straight from a scan or shuffle and a hot host's pages can be split
    known = materialize(
        known.join(hosts.select("key", F.col("bound").alias("by_host")), "key", "left")
        .join(domains.select("domain", F.col("bound").alias("by_domain")), "domain", "left")
        .join(by_suffix.select("suffix", F.col("bound").alias("by_suffix")), "suffix", "left")
        .select("key", F.coalesce("by_host", "by_domain", "by_suffix", F.lit(unknown)).alias("bad_bound"))
    )
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return rows.withColumn("key", key_of(F.col("host"))).join(known, "key", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_bound"
    )


@register("op6_url_reputation")
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page's url ends in the number of its document, and ``labels`` marks some of those."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.try_to_number(F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:\\.html)?/?$", 1), F.lit("9" * 18)).cast("bigint")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.greatest(1 - F.col("quality"), F.col("toxic"))).alias("bad"))
    outcomes = pages.select(host_of(F.col("url")).alias("host"), number.alias("doc_id")).join(marks, "doc_id").select("host", "bad")
    return judge(pages, outcomes)
