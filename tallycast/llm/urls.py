"""URL filters: rules first, then host reputations shrunk by empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .words import lowered

#: Fixed rules of the query: (host and path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LEVELS = ["suffix", "domain", "host"]


@dataclass(frozen=True)
class Prior:
    """How far reputations are shrunk and when a host is blocked."""

    #: A host is blocked if its share of faulty pages is above this with the certainty of the bound below.
    worst: float = 0.25
    #: One-sided normal quantile of the posterior bound (0.90).
    z: float = 1.2815515655446004
    #: Limits of the correlation within a group, so a prior weighs as much as 1 to 999 pages.
    least: float = 0.001
    most: float = 0.5


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is ``host`` or one above it, and whose path begins ``path``; null if none fits."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, begin = rule.partition("/")
        fits.append(F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + begin), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _correlation(groups: DataFrame, prior: Prior) -> float:
    """How far groups (n, k, away: their parent's mean without them) spread beyond binomial noise, between the prior's limits.

    Each group of two pages or more gives an estimate, weighed by its inverse variance for the correlation found so far: that weight is
    bounded however many pages a group has, so none dominates. It depends on n alone, so what is collected is a row for each different n.
    """
    n, k, m = F.col("n"), F.col("k"), F.col("away")
    own = ((k - n * m) ** 2 / (n * m * (1 - m)) - 1) / (n - 1)
    rows = [(r["n"], r["groups"], r["sum"]) for r in groups.where(n > 1).groupBy("n").agg(F.count("*").alias("groups"), F.sum(own).alias("sum")).orderBy("n").collect()]
    rho, before = prior.most, None
    for _ in range(200):
        if not rows or rho == before:
            break
        before = rho
        weights = [((n - 1) / (1 + (n - 1) * rho)) ** 2 for n, _, _ in rows]
        rho = sum(w * x for w, (_, _, x) in zip(weights, rows, strict=True)) / sum(w * c for w, (_, c, _) in zip(weights, rows, strict=True))
        rho = min(max(rho, prior.least), prior.most)
    return rho if rows else prior.least


def shrunk(counts: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """(host, n, k, mean, alpha, beta) from ``counts`` (host, n, k): labelled pages and faulty ones of each host.

    Top down: the suffixes are shrunk to the share of all pages, the domains to their suffix, the hosts to their domain, each with a beta prior
    of the parent's mean. How much the prior of a level weighs is estimated from how far its groups spread beyond
    binomial noise around their parent's mean without them (moments of beta-binomial groups). Hosts without labels get their domain's mean.
    """
    base = counts.select("host", F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"))
    base = base.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    overall = base.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    # A page of each outcome is added, so the mean is never 0 or 1.
    start = ((overall["k"] or 0.0) + 1) / ((overall["n"] or 0.0) + 2)
    means: DataFrame | None = None
    for level, parent in zip(LEVELS, [None, *LEVELS[:-1]], strict=True):
        keys = [level] if parent is None else [level, parent]
        groups = base.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        n, k, m = F.col("n"), F.col("k"), F.col("m")
        if means is None:
            groups = groups.withColumns({"m": F.lit(start), "away": ((overall["k"] or 0.0) - k + 1) / ((overall["n"] or 0.0) - n + 2)})
        else:
            above = means.select(F.col(parent), F.col("mean").alias("m"), F.col("alpha").alias("a"), F.col("beta").alias("b"))
            groups = groups.join(above, parent).withColumn("away", (F.col("a") - k) / (F.col("a") + F.col("b") - n)).drop("a", "b")
        rho = _correlation(groups, prior)
        weight = 1 / rho - 1
        means = groups.withColumns({"alpha": k + weight * m, "beta": n - k + weight * (1 - m)})
        means = means.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return means.select("host", "n", "k", "mean", "alpha", "beta")


def lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Lower posterior bound of a beta distribution, by a normal one on the log-odds (their variance is about 1/alpha + 1/beta)."""
    odds = F.log(alpha / beta) - z * F.sqrt(1 / alpha + 1 / beta)
    return 1 / (1 + F.exp(-odds))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, prior: Prior = Prior()) -> DataFrame:
    """(page_id, host, path, rule, verdict, fault_rate, fault_bound), a row for each row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, faulty 0/1) covers some of the pages. Pages are summed by host before anything is moved; what is joined
    back is a row for each host. A null url, or one without ``://``, has an empty host, which is judged like any other.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marked = outcomes.where("faulty is not null").groupBy("page_id").agg(F.max("faulty").alias("faulty"))
    counts = split.join(marked, "page_id", "left").groupBy("host").agg(F.count("faulty").alias("n"), F.coalesce(F.sum("faulty"), F.lit(0)).alias("k"))
    counts = store.written(counts, "hosts")  # every level is estimated from these
    hosts = shrunk(counts, prior).select("host", F.col("mean").alias("fault_rate"), lower_bound(F.col("alpha"), F.col("beta"), prior.z).alias("fault_bound"))
    out = split.join(hosts, "host").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.element_at(F.create_map(*[F.lit(x) for pair in rules for x in pair]), F.col("rule")) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(F.col("fault_bound") > prior.worst, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "fault_rate", "fault_bound")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, faulty): a page is made from the document whose number ends its url's path; it's as faulty as that."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long")
    named = pages.select("page_id", number.alias("doc_id")).where("doc_id is not null")
    marks = labels.where("quality is not null or toxic is not null").select("doc_id", F.when((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1), 1).otherwise(0).alias("faulty"))
    return named.join(marks, "doc_id").select("page_id", "faulty")
