"""Mixing sources to target weights by hash thresholds that histograms find.

A document's hash decides which part of its source it belongs to: a source that may take a certain number of words takes the documents
below a threshold of the hash. The threshold comes from the sums of sizes by source and hash bucket: first of all documents over coarse
buckets, then only of those in the bucket where the budget runs out, over finer ones, until one hash is left. Nothing is sorted; a
larger budget has a higher threshold, so what a smaller one takes is part of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.operators.places import numbered

from . import store
from .words import SPACED

#: A hash is so many hexadecimal digits of an MD5 sum.
DIGITS = 15


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in the order of their names, repeating; no source and no document is taken more than ``most`` times."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: int = 42
    #: Bits of the hash that each histogram adds; a divisor of 60.
    bits: int = 12

    @property
    def levels(self) -> int:
        return 4 * DIGITS // self.bits


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """(row, doc_id, source, size, hash) of every document, written. The hash is of seed, doc_id and text, so copies share theirs."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    read = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long").alias("hash"),
    )
    return store.written(read.withColumn("row", F.monotonically_increasing_id()), "sized")


def targets(rows: DataFrame, mix: Mix, percents: tuple[int, ...]) -> DataFrame:
    """(source, source_size, goals): for every source and percentage its (percent, target, copies, want).

    The shares are of that percentage of all words. ``copies`` is how often the whole source is taken, ``want`` the words on top of it. A source whose share is
    above ``most`` times its size stops there; what it leaves is shared by the others, again by weight. Only sums over all sources
    meet the driver, once for each round of sharing.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = numbered(by_source, F.col("source").asc_nulls_last(), name="place", cut=lambda f: store.written(f, "ranked"))
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("place") - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    by_source = store.written(by_source.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    everything, weights = by_source.agg(F.sum("source_size"), F.sum("weight")).first()
    goals = [_goal(F.lit(percent), *_shared(by_source, mix, (everything or 0) * percent // 100, weights or 0), mix) for percent in percents]
    return store.written(by_source.select("source", "source_size", F.array(*goals).alias("goals")), "targets")


def _stopped(rest: int, weights: int, mix: Mix) -> Column:
    """Whether a source's share of ``rest`` is above its stop, in exact numbers."""
    wide = lambda x: x.cast("decimal(38,0)")
    return wide(F.col("source_size")) * wide(F.lit(mix.most * weights)) < wide(F.lit(rest)) * wide(F.col("weight"))


def _shared(by_source: DataFrame, mix: Mix, budget: int, weights: int) -> tuple[int, int]:
    """The words and the weights of the sources that don't stop. The share of a weight only rises, so a source that stops stays so."""
    rest, open_weights = budget, weights
    while True:
        stops = _stopped(rest, open_weights, mix)
        held, left = by_source.agg(F.sum(F.when(stops, F.col("source_size") * mix.most)), F.sum(F.when(~stops, F.col("weight")))).first()
        now = budget - (held or 0), left or 0
        if now == (rest, open_weights):
            return now
        rest, open_weights = now


def _goal(percent: Column, rest: int, weights: int, mix: Mix) -> Column:
    """(percent, target, copies, want) of a source."""
    size = F.col("source_size")
    share = F.when(F.lit(weights > 0), F.lit(rest) * F.col("weight") / F.lit(max(weights, 1)).cast("double")).otherwise(0.0)
    target = F.when(_stopped(rest, weights, mix), (size * mix.most).cast("double")).otherwise(F.lit(share))
    copies = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    return F.struct(percent.alias("percent"), target.alias("target"), copies.alias("copies"), (target - copies * size).alias("want"))


def _bucket(level: int, mix: Mix) -> Column:
    """The bits of the hash that ``level`` histograms have seen."""
    return F.shiftright("hash", 4 * DIGITS - mix.bits * level)


def thresholds(rows: DataFrame, goals: DataFrame, mix: Mix) -> DataFrame:
    """(source, percent, edge_hash, edge_size, edge_copies, edge_rows): where each budget runs out.

    All documents with a smaller (hash, size) are taken once more, and ``edge_copies`` of the ``edge_rows`` with just that one: the number
    that comes nearest to the budget. A source of one document, or of thousands of copies of one, ends there as well.
    """
    wants = goals.select("source", F.explode("goals").alias("goal")).select("source", "goal.percent", "goal.want")
    same_source = F.col("source").eqNullSafe(F.col("_source"))
    # One histogram of all documents serves every budget.
    sums = store.written(_summed(rows.select(F.col("source").alias("_source"), _bucket(1, mix).alias("bucket"), "size"), "_source"), "histogram")
    left = wants.withColumn("below", F.lit(0).cast("long")).join(sums, same_source).drop("_source")
    edges = store.written(_run_out(left), "edges")
    inside = rows.select(F.col("source").alias("_source"), "hash", "size").join(edges.select("source", "percent", "bucket"), same_source & (_bucket(1, mix) == F.col("bucket")))
    for level in range(1, mix.levels + 1):
        # Only documents in a budget's last bucket are left from here on; at the end that is one hash, and sizes tell apart what shares it by chance.
        inside = store.written(inside.select("_source", F.col("percent").alias("_percent"), "hash", "size"), "boundary")
        same = same_source & (F.col("percent") == F.col("_percent"))
        finer = F.col("size") if level == mix.levels else _bucket(level + 1, mix)
        sums = _summed(inside.select("_source", "_percent", finer.alias("bucket"), "size"), "_source", "_percent")
        left = edges.select("source", "percent", "want", "below", F.col("bucket").alias("outer")).join(sums, same).drop("_source", "_percent")
        edges = store.written(_run_out(left), "edges")
        inside = inside.join(edges.select("source", "percent", "bucket"), same & (_bucket(level + 1, mix) == F.col("bucket")))
    nearest = F.floor((F.col("want") - F.col("below")) / F.col("bucket") + 0.5)
    copies = F.when(F.col("bucket") > 0, F.greatest(F.lit(0), F.least(nearest, F.col("rows")))).otherwise(0).cast("long")
    return edges.select("source", "percent", F.col("outer").alias("edge_hash"), F.col("bucket").alias("edge_size"), copies.alias("edge_copies"), F.col("rows").alias("edge_rows"))


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))


def _run_out(left: DataFrame) -> DataFrame:
    """The bucket of each (source, percent) in which ``want`` runs out; ``below`` becomes the words before it. No more rows than buckets meet."""
    budget = Window.partitionBy("source", "percent")
    after = left.withColumn("after", F.col("below") + F.sum("words").over(budget.orderBy("bucket")))
    over = F.min(F.when(F.col("after") > F.col("want"), F.col("bucket"))).over(budget)
    found = after.withColumn("over", over).where("bucket = over").withColumn("below", F.col("after") - F.col("words"))
    return found.drop("after", "over", "words")


def mixed(docs: DataFrame, mix: Mix = Mix(), percents: tuple[int, ...] = (100,)) -> DataFrame:
    """(doc_id, source, size, source_size, takes) for every row of ``docs`` (doc_id, text, source; more columns don't matter).

    ``takes`` has an entry (percent, target, taken) for every one of ``percents``: what a mix of so much of all words wants of the
    document's source, and the words it takes of this document, repeats counted. What a smaller percentage takes of a document is never more than
    what a larger one takes.

    ``size`` is the number of white-space separated words, 0 for null or empty texts, which nothing is taken of. A null source is the last source. Copies,
    and rows without a doc_id, are documents of their own: if the budget ends among equal rows, just so many of them are taken. Results depend on the rows alone, not on
    their order or partitions. An empty table gives an empty one.
    """
    rows = sized(docs, mix)
    goals = targets(rows, mix, percents)
    ends = store.written(thresholds(rows, goals, mix), "thresholds")
    of_source = ends.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("percent", "edge_hash", "edge_size", "edge_copies", "edge_rows"))).alias("ends"))
    named = goals.join(of_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    named = store.written(named, "goals").withColumnRenamed("source", "_source")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    counted = _equal_rows(rows, ends)
    out = out.join(counted, "row", "left") if counted is not None else out.withColumn("lucky", F.lit(None).cast("array<int>"))

    def take(goal: Column) -> Column:
        end = F.get(F.filter("ends", lambda e: e["percent"] == goal["percent"]), F.lit(0))
        place = F.struct("hash", "size")
        edge = F.struct(end["edge_hash"], end["edge_size"])
        equal = (end["edge_copies"] == end["edge_rows"]) | F.coalesce(F.array_contains("lucky", goal["percent"]), F.lit(False))
        more = F.when(end.isNull(), False).when(place < edge, True).when(place == edge, equal).otherwise(False)
        return F.struct(goal["percent"].alias("percent"), goal["target"].alias("target"), (F.col("size") * (goal["copies"] + more.cast("long"))).alias("taken"))

    return out.select("doc_id", "source", "size", "source_size", F.transform("goals", take).alias("takes"))


def _equal_rows(rows: DataFrame, ends: DataFrame) -> DataFrame | None:
    """(row, lucky): for rows among equal ones that a budget takes only some of, the percentages that take this one; None if there are none."""
    split = ends.where("edge_copies > 0 AND edge_copies < edge_rows").withColumnRenamed("source", "_source")
    if split.isEmpty():
        return None
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("hash") == F.col("edge_hash")) & (F.col("size") == F.col("edge_size"))
    equal = rows.join(split, same).select("_source", "percent", "edge_copies", "row")
    placed = numbered(equal, F.col("_source").asc_nulls_last(), F.col("percent"), F.col("row"), cut=lambda f: store.written(f, "equal"))
    placed = store.written(placed, "equal")
    first = placed.groupBy(F.col("_source").alias("source"), F.col("percent").alias("_percent")).agg(F.min("place").alias("first"))
    placed = placed.join(first, F.col("source").eqNullSafe(F.col("_source")) & (F.col("percent") == F.col("_percent")))
    # Whole rows are alike, so it doesn't matter which are taken, as long as a larger percentage takes them too: the first in the order of row.
    return placed.where(F.col("place") - F.col("first") < F.col("edge_copies")).groupBy("row").agg(F.collect_list("percent").alias("lucky"))
