"""Quality classifier: rules cut from tree paths, weighted by a lasso, compiled to one column expression."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .words import words


@dataclass(frozen=True)
class Settings:
    """How rules are found and weighted."""

    #: At most about so many labelled rows are used to fit; a hash of doc_id picks them.
    rows: int = 40_000
    trees: int = 20
    depth: int = 4
    lasso: float = 0.001
    iterations: int = 100
    seed: int = 11


#: The statistics that rules speak of.
STATISTICS = ["log_words", "word_length", "upper", "symbols", "marks", "digits", "distinct", "stutter", "line_words", "dup_lines", "capitals"]


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the statistics (double) of each whole text; null is empty, and shares of nothing are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(*keep, text.alias("_text"), words(text).alias("_words"))
    n, chars = F.size("_words"), F.length(F.array_join("_words", ""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    left_out = lambda signs: F.length("_text") - F.length(F.regexp_replace("_text", signs, ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != "")
    pairs = F.arrays_zip(F.slice("_words", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("_words", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    read = read.withColumn("_lines", lines)
    found = {
        "log_words": F.log1p(n), "word_length": share(chars, n), "upper": share(left_out("[A-ZÀ-ÖØ-Þ]"), chars), "symbols": share(left_out("[#*$%&|<>]"), chars),
        "marks": share(left_out("[!?]"), n), "digits": share(left_out("[0-9]"), chars), "distinct": share(F.size(F.array_distinct("_words")), F.sqrt(n)),
        "stutter": share(F.size(F.filter(pairs, lambda x: x["a"] == x["b"])), n), "line_words": share(n, F.size("_lines")),
        "dup_lines": share(F.size("_lines") - F.size(F.array_distinct("_lines")), F.size("_lines")), "capitals": share(left_out(r"(?<![^\x20\x09-\x0D])[A-ZÀ-ÖØ-Þ]"), n),
    }
    return read.select(*keep, *[found[name].cast("double").alias(name) for name in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions: (statistic, bound, whether it's to exceed the bound)."""

    conditions: tuple[tuple[str, float, bool], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > F.lit(x) if over else F.col(s) <= F.lit(x) for s, x, over in self.conditions])


@dataclass(frozen=True)
class Ensemble:
    """Rules that the lasso left, with their weights."""

    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of quality as an expression of the statistics."""
        z = reduce(lambda a, b: a + b, [F.when(rule.column(), F.lit(w)).otherwise(0.0) for rule, w in self.weighted], F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))


SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")


def paths(tree: str, names: list[str]) -> list[Rule]:
    """Rules of all inner and leaf nodes of a tree printed by Spark, in order; conditions on one statistic and side are merged."""
    found, stack = [], []
    for line in tree.splitlines():
        match = SPLIT.match(line)
        if not match:
            continue
        depth = len(match[1])
        stack = [(d, c) for d, c in stack if d < depth]
        stack.append((depth, (names[int(match[3])], float(match[5]), match[4] == ">")))
        tight: dict[tuple[str, bool], float] = {}
        for _, (name, bound, over) in stack:
            before = tight.get((name, over))
            tight[name, over] = bound if before is None else (max if over else min)(before, bound)
        found.append(Rule(tuple((name, bound, over) for (name, over), bound in sorted(tight.items()))))
    return found


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Ensemble:
    """An ensemble from ``labelled`` (statistics, label 0/1).

    A random forest proposes, the lasso chooses. Without rows, or with one outcome only, the score is constant.
    """
    rows = labelled.select(F.array(*STATISTICS).alias("all"), F.col("label").cast("double").alias("label"), *STATISTICS).withColumn("features", array_to_vector("all"))
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    share = min(max((good or 0.0) / n if n else 0.5, 1e-6), 1 - 1e-6)
    constant = Ensemble(math.log(share / (1 - share)), ())
    if not n or good in (0, n):
        return constant
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, minInstancesPerNode=5, featureSubsetStrategy="sqrt").fit(rows)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree.toDebugString, STATISTICS)))
    if not rules:
        return constant
    told = rows.select("label", array_to_vector(F.array(*[F.when(rule.column(), 1.0).otherwise(0.0) for rule in rules])).alias("features"))
    told = store.written(told, "rule-rows")
    model = LogisticRegression(elasticNetParam=1.0, regParam=settings.lasso, maxIter=settings.iterations, standardization=True).fit(told)
    kept = tuple((rule, float(w)) for rule, w in zip(rules, model.coefficients.toArray(), strict=True) if w)
    return Ensemble(float(model.intercept), kept)


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; labels are learned from rows that aren't held out.

    Texts are read once: their statistics are written, and both the fit and the scores use these.
    """
    stats = store.written(statistics(docs.withColumn("_held", held_out), "doc_id", "_held"), "statistics")
    marks = labels.where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    labelled = stats.where("not _held").join(marks, "doc_id")
    share = min(1.0, settings.rows / max(labelled.count(), 1))
    labelled = store.written(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "labelled")
    ensemble = fit(labelled, settings)
    score = stats.select("doc_id", F.col("_held").alias("held_out"), ensemble.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
