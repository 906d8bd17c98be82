"""Quality rules whose cutoffs are proven on labelled holdouts: few good documents are rejected, in every stratum.

Built of DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store
from .textstats import counted


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)




#: Each rule rejects what exceeds its cutoff; the cutoffs are tried from the loosest to the strictest.
CUTOFFS: dict[str, list[float]] = {
    "symbols": [x / 100 for x in range(60, 0, -2)],
    "dup_lines": [x / 100 for x in range(95, 0, -5)],
    "repeats": [x / 200 for x in range(60, 0, -2)],
    "long_words": [x / 4 for x in range(80, 16, -1)],
    "short_words": [-x / 4 for x in range(2, 20)],
}


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Name to (statistic, cutoffs)."""
    values = {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "long_words": _share("word_chars", "n_words"),
        "short_words": -_share("word_chars", "n_words"),
    }
    return {name: (value, CUTOFFS[name]) for name, value in values.items()}


@dataclass(frozen=True)
class Risk:
    """All rules together reject at most ``rate`` of the good documents of a stratum, with probability 1 - ``doubt`` for all strata at once."""

    rate: float = 0.02
    doubt: float = 0.05


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of n draws with probability p, by the recurrence of its terms' logarithms; exact but for rounding.

    Above the mean the tail is over one half in any case we ask of, so only terms up to there are summed: 1 is returned.
    """
    state = F.struct((n * F.log(1 - p)).alias("log"), F.exp(n * F.log(1 - p)).alias("sum"))

    def step(have: Column, i: Column) -> Column:
        log = have["log"] + F.log((n - i + 1) / i) + F.log(p / (1 - p))
        return F.struct(log.alias("log"), (have["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.aggregate(terms, state, step, lambda have: have["sum"]), F.lit(1.0)))


def thresholds(good: DataFrame, stratum: str, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff) from the statistics of ``good``, labelled good documents: the strictest cutoff that's proven.

    For each rule and stratum the cutoffs are tested in a fixed order, from the loosest on, until one fails: then none of the stricter counts,
    and the order needs no correction. A cutoff passes if so few good documents would be rejected that a rejection rate of
    ``rate`` / rules has an exact binomial probability of at most ``doubt`` / (rules * strata), Bonferroni's share.
    A stratum with too few labels has no cutoffs, so nothing is rejected there. A null stratum is one of its own.
    """
    known = rules()
    each = F.array(*[
        F.struct(F.lit(name).alias("rule"), sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("fails"))
        for name, (value, cuts) in known.items()
    ])
    # How many cutoffs reject a document; the loosest ones don't, as they're ordered.
    counts = good.select(F.col(stratum).alias("stratum"), F.explode(each).alias("r")).groupBy("stratum", "r.rule", "r.fails").agg(F.count("*").alias("n"))
    rows = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fails", "n"))).alias("by_fails"))
    order = F.create_map(*[x for name, (_, cuts) in known.items() for x in (F.lit(name), F.array(*[F.lit(float(c)) for c in cuts]))])
    tried = rows.select("stratum", "rule", "n", "by_fails", F.posexplode(order[F.col("rule")]).alias("place", "cutoff"))
    size = F.size(order[F.col("rule")])
    # The cutoff at `place` rejects those that at least size - place cutoffs reject.
    rejected = F.aggregate(F.filter(F.map_entries("by_fails"), lambda e: e["key"] >= size - F.col("place")), F.lit(0).cast("long"), lambda have, e: have + e["value"])
    tried = tried.select("stratum", "rule", "n", "place", "cutoff", rejected.alias("k"))
    strata = rows.agg(F.count_distinct(F.struct("stratum")).alias("strata"))
    tried = tried.join(F.broadcast(strata))  # one row
    passed = binomial_tail(F.col("k"), F.col("n"), F.lit(risk.rate / len(known))) <= F.lit(risk.doubt) / (len(known) * F.col("strata"))
    tried = tried.withColumn("failed", F.max(F.when(passed, 0).otherwise(1)).over(W.partitionBy("stratum", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    return tried.where("failed = 0").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by), a row for each row of ``docs``.

    Texts are read once; the statistics are written, so the labels are joined to numbers, and the few thresholds too.
    Labels of unknown documents and null labels are left out.
    """
    stats = store.written(counted(docs, "doc_id", stratum).withColumn("base_failed", base_failed()), "quality")
    good = stats.where("not base_failed").join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    cuts = store.written(thresholds(good, stratum, risk), "cutoffs")
    by_stratum = cuts.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    out = stats.join(by_stratum, stats[stratum].eqNullSafe(by_stratum["_stratum"]), "left")
    broken = F.array_compact(F.array(*[F.when(value > F.element_at("cut", name), F.lit(name)) for name, (value, _) in rules().items()]))
    return out.withColumn("rejected_by", broken).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by",
    )
