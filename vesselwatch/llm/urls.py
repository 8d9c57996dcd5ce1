"""URL verdicts: explicit rules first, else the reputation of the host.

Reputation is empirical Bayes. The share of bad pages among a host's labelled pages is shrunk through
beta-binomial priors: the whole table gives the prior of each suffix, the suffix that of its registered
domains, the domain that of its hosts. How strongly a level shrinks is estimated from the spread of its
members' shares (method of moments). A host is blocked if even the lower posterior bound of its share
exceeds a limit, so a host is never blocked on a handful of labels unless its domain is bad too. A host
without labels has its prior: the mean of its domain, else of its suffix, else of the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import lookup_join, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower posterior bound: mean - Z standard deviations (5 % one-sided).
Z = 1.645
#: A host is blocked if the bound of its share of bad pages exceeds this.
MAX_BAD = 0.5
#: Pseudo-counts that a prior may have.
LEAST, MOST = 1.0, 1000.0
#: Second-level public suffixes by country: names are registered one label below them. A bounded list of common ones.
SECOND_LEVEL = {
    "ar": "com edu gob net org", "au": "asn com edu gov id net org", "br": "com edu gov net org", "cn": "ac com edu gov net org", "co": "com edu gov net org",
    "hk": "com edu gov net org", "id": "ac co go or sch web", "il": "ac co gov net org", "in": "ac co edu firm gen gov ind net org", "jp": "ac ad co ed go gr lg ne or",
    "ke": "ac co go ne or", "kr": "ac co go ne or pe re", "mx": "com edu gob net org", "my": "com edu gov net org", "ng": "com edu gov net org",
    "nz": "ac co geek gen govt iwi maori net org school", "pe": "com edu gob net org", "ph": "com edu gov net org", "pk": "com edu gov net org",
    "pl": "com edu gov net org", "sg": "com edu gov net org", "th": "ac co go in net or", "tr": "bel com edu gov k12 net org", "tw": "com edu gov idv net org",
    "ua": "com edu gov in net org", "uk": "ac co gov ltd me net nhs org plc police sch", "ve": "co com edu gob net org", "vn": "com edu gov net org",
    "za": "ac co edu gov net org web",
}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: a label and the public suffix (one label, or two of ``SECOND_LEVEL``).

    Login, port and a dot at the end don't belong to it; an IP address is its own domain.
    """
    name = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$|\.(?=(?::[0-9]*)?$)", "")
    second = [f"{label}.{country}" for country, labels in SECOND_LEVEL.items() for label in labels.split()]
    two = F.substring_index(name, ".", -2)
    return (
        F.when(name.rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"), name)
        .when(two.isin(second), F.substring_index(name, ".", -3))
        .otherwise(two)
    )


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The (rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else null.

    A rule fits its host and the subdomains, if the path starts with the rule's. Of equally long ones
    that with the longer host wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength() -> Column:
    """Pseudo-counts of a level's prior from Kleinman's moment estimate of the intra-class correlation.

    Aggregates the members' n, bad and prior mean ``p`` to one value.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("p"), 2))
    noise = F.sum(F.col("p") * (1 - F.col("p")))
    most = F.sum(F.col("n") * F.col("p") * (1 - F.col("p")))
    rho = F.when(most > noise, (spread - noise) / (most - noise))
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.when(rho > 0, (1 - rho) / rho).otherwise(F.lit(MOST))))


def _shrink(members: DataFrame, key: str, up: str, prior: DataFrame) -> DataFrame:
    """Posterior of each member of a level: mean ``p``, pseudo-counts ``k`` (its own labels and the prior's).

    A member without labels has the prior's mean; the spreads of all levels since the last one with labels
    add up (``free``: what is left of p(1-p) below them), so it has the fewer pseudo-counts the further that is.
    """
    joined = members.join(prior.select(F.col(up), F.col("p"), F.col("free")), up)
    strength = joined.where("n > 0").agg(_strength()).first()[0]  # one number
    joined = joined.withColumn("s", F.lit(strength))
    own = F.col("n") > 0
    free = F.when(own, 1.0).otherwise(F.col("free") * F.col("s") / (F.col("s") + 1))
    return joined.select(
        key, up, "n", "bad", ((F.col("bad") + F.col("s") * F.col("p")) / (F.col("n") + F.col("s"))).alias("p"),
        F.when(own, F.col("n") + F.col("s")).otherwise(1 / (1 - F.col("free") * F.col("s") / (F.col("s") + 1)) - 1).alias("k"), free.alias("free"),
    )


def host_reputation(outcomes: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """(host, bad_mean, bad_bound) for each host of ``outcomes`` (host, bad 0/1) and of ``hosts`` (host).

    Hosts are grouped by registered domain and by their last label (suffix). Hosts of ``hosts`` without
    an outcome have the prior of the nearest level with any. Rows with a null host or outcome are ignored;
    without any outcome the result is empty.
    """
    counted = outcomes.where("host is not null and bad is not null").select("host", F.lit(1.0).alias("n"), F.col("bad").cast("double").alias("bad"))
    if hosts is not None:
        counted = counted.union(hosts.where("host is not null").select("host", F.lit(0.0), F.lit(0.0)))
    hosts = materialize(
        counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", F.substring_index("domain", ".", -1)),
        "hosts",
    )
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total).withColumn("root", F.lit(0))
    root = suffixes.groupBy("root").agg(*total).where("n > 0").select("root", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("p"), F.lit(1.0).alias("free"))
    by_suffix = materialize(_shrink(suffixes, "suffix", "root", root), "suffixes")
    by_domain = materialize(_shrink(domains, "domain", "suffix", by_suffix), "domains")
    by_host = _shrink(hosts.drop("suffix"), "host", "domain", by_domain)
    sd = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("k") + 1))
    return by_host.select("host", F.col("p").alias("bad_mean"), (F.col("p") - Z * sd).alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """(id, host, path, rule, verdict, bad_mean, bad_bound) for each row of ``pages``.

    ``labels``: (id, bad 0/1) of some pages; of repeated ids the worst counts. ``rules`` are a short list
    of parameters (verdict, host, path). The verdict is ``allow`` or ``block``: that of the longest
    fitting rule, else block if the host's bound exceeds ``max_bad``; a host without labels is judged by its
    domain, suffix or the whole table, and allowed if there is no label at all.

    Defined cases: a null url or one without ``://`` has empty host and path and is allowed (its labels
    count for no host); rows with null ids are judged like others but carry no label; repeated rows are
    each judged; empty tables give an empty result; other columns are ignored.
    """
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    worst = labels.select("id", "bad").where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    named = judged.where("host <> ''")
    outcomes = named.select("id", "host").distinct().join(worst, "id").select("host", "bad")
    found = match_rule(F.col("host"), F.col("path"), rules)
    return (
        lookup_join(judged, materialize(host_reputation(outcomes, named.select("host").distinct()), "reputation"), "host", F.xxhash64("id", "path"))
        .withColumn("found", found)
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
            F.coalesce("found.verdict", F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
            "bad_mean", "bad_bound",
        )
    )
