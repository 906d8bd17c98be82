"""Toxicity by a classifier chain: categories in order, each a linear model that also sees the earlier ones' probabilities."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, workers

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words are features too: inflected forms share them.
PREFIXES = (4, 5)


@dataclass(frozen=True)
class Settings:
    """How a chain is trained."""

    #: At most about so many labelled rows are used to fit; a hash of doc_id picks them.
    rows: int = 60_000
    #: Features kept for each category, by how much they tell.
    features: int = 2000
    least_docs: int = 3
    #: And least log-likelihood ratio: rarer words than this allows tell nothing.
    least_telling: float = 12.0
    folds: int = 3
    ridge: float = 1e-3
    iterations: int = 25


@dataclass
class Chain:
    """A fitted chain; small enough to go to every task."""

    categories: list[str]
    weights: dict[str, list[float]] = field(default_factory=dict)  # one weight for each category
    intercepts: list[float] = field(default_factory=list)
    links: list[list[float]] = field(default_factory=list)  # of a category, on the probabilities of the earlier ones

    def probabilities(self, features: set[str]) -> list[float]:
        sums = list(self.intercepts)
        for feature in features & self.weights.keys():
            for i, weight in enumerate(self.weights[feature]):
                sums[i] += weight
        out: list[float] = []
        for i, z in enumerate(sums):
            z += sum(w * p for w, p in zip(self.links[i], out, strict=True))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def features_of(text: str | None) -> set[str]:
    """The distinct words of a text, lower-cased, and the beginnings of the longer ones."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def _slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in lists of about ``size`` bytes, each with its place: whole batches of texts as Python objects take much memory."""
    step = max(1, int(len(texts) * size / max(texts.nbytes, 1)))
    for at in range(0, len(texts), step):
        yield at, texts.slice(at, step).to_pylist()


def _counts(categories: int, most: int = 100_000) -> Callable:
    """Counts of features for a task, given out whenever too many have come together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list[int]] = defaultdict(lambda: [0] * (categories + 1))

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.list_(pa.int64()))]
            have.clear()
            return pa.RecordBatch.from_arrays(columns, ["feature", "n"])

        for batch in batches:
            labels = batch.column("labels").to_pylist()
            for at, texts in _slices(batch.column("text")):
                for place, text in enumerate(texts, at):
                    for feature in features_of(text):
                        n = have[feature]
                        n[0] += 1
                        for i, label in enumerate(labels[place]):
                            n[i + 1] += label
                if len(have) > most:
                    yield out()
        yield out()

    return count


def _indexed(vocabulary: dict[str, int]) -> Callable:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features_of(text) & vocabulary.keys()) for _, texts in _slices(batch.column("text")) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("labels"), pa.array(found, pa.list_(pa.string()))], ["fold", "labels", "found"])

    return index


def _telling(n: Column, positive: Column, docs: int, positives: int) -> Column:
    """Log-likelihood ratio of a feature and a category."""

    def term(k: Column, e: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)

    rate = positives / docs
    rest, rest_positive = docs - n, positives - positive
    return term(positive, n * rate) + term(n - positive, n * (1 - rate)) + term(rest_positive, rest * rate) + term(rest - rest_positive, rest * (1 - rate))


def fit(labelled: DataFrame, categories: list[str], settings: Settings = Settings()) -> Chain:
    """A chain over ``labelled`` (doc_id, text, and a 0/1 column for each category; rows with a null label are left out).

    For every category in turn: models fitted without a fold predict it, so the later categories are trained on probabilities
    that their rows had no part in; a model of all rows is kept for use. Without rows, or for a category with only one
    outcome, the probability is constant: the share of ones; so it is if no word tells anything.
    """
    # Not at the top: the Python workers import this module too, and pyspark.ml with pandas takes 30 MB of each.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    labels = F.array(*[F.col(c).cast("int") for c in categories])
    rows = labelled.select("doc_id", "text", labels.alias("labels")).where(~F.exists("labels", lambda x: x.isNull()))
    rows = store.written(rows, "toxic-labelled")
    sums = rows.agg(F.count("*"), *[F.sum(F.col("labels")[i]) for i in range(len(categories))]).first()
    docs, positives = sums[0], [x or 0 for x in sums[1:]]
    chain = Chain(list(categories))
    if not docs:
        return Chain(list(categories), {}, [-30.0] * len(categories), [[0.0] * i for i in range(len(categories))])

    counted = rows.select("text", "labels").mapInArrow(workers.lean(_counts(len(categories))), "feature string, n array<bigint>")
    sums_of = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(len(categories) + 1)]
    counted = store.written(counted.groupBy("feature").agg(*sums_of).where(F.col("n0") >= settings.least_docs), "toxic-features")
    vocabulary: dict[str, int] = {}
    for i, positive in enumerate(positives):
        if 0 < positive < docs:
            telling = counted.withColumn("tells", _telling(F.col("n0"), F.col(f"n{i + 1}"), docs, positive)).where(F.col("tells") >= settings.least_telling)
            best = telling.orderBy(F.col("tells").desc(), "feature").limit(settings.features)
            for row in best.select("feature").collect():  # `features` rows at most
                vocabulary.setdefault(row["feature"], len(vocabulary))

    size = len(vocabulary)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(settings.folds)).cast("int")
    indexed = rows.select(fold.alias("fold"), "labels", "text").mapInArrow(workers.lean(_indexed(vocabulary)), "fold int, labels array<int>, found array<string>")
    if size:
        indexed = CountVectorizerModel.from_vocabulary(list(vocabulary), "found", "base", binary=True).transform(indexed)
    indexed = indexed.select("fold", "labels", *["base"] * bool(size), F.array().cast("array<double>").alias("chain"))
    indexed = store.written(indexed, "toxic-rows")
    for i, positive in enumerate(positives):
        if not 0 < positive < docs or size + i == 0:
            share = positive / docs
            chain.intercepts.append(math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0)
            chain.links.append([0.0] * i)
            for weights in chain.weights.values():
                weights.append(0.0)
            indexed = indexed.withColumn("chain", F.concat("chain", F.array(F.lit(share))))
            continue
        both = VectorAssembler(inputCols=["base"] * bool(size) + ["links"] * bool(i), outputCol="features")
        train = both.transform(indexed.select("*", F.col("labels")[i].cast("double").alias("label"), array_to_vector("chain").alias("links")))
        learner = LogisticRegression(regParam=settings.ridge, maxIter=settings.iterations, standardization=True)
        model = learner.fit(train)
        coefficients = model.coefficients.toArray()
        chain.intercepts.append(float(model.intercept))
        chain.links.append([float(x) for x in coefficients[size:]])
        for feature, k in vocabulary.items():
            chain.weights.setdefault(feature, []).append(float(coefficients[k]))
        if i + 1 < len(positives):
            parts = [learner.fit(train.where(F.col("fold") != f)).transform(train.where(F.col("fold") == f)) for f in range(settings.folds)]
            unseen = parts[0]
            for part in parts[1:]:
                unseen = unseen.union(part)
            grown = F.concat("chain", F.array(vector_to_array("probability")[1])).alias("chain")
            indexed = store.written(unseen.select("fold", "labels", *["base"] * bool(size), grown), "toxic-rows")
    return chain


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, one probability for each category) for each row of ``docs``; a null text is an empty one.

    Every row is scored by its text alone, so rows that repeat a doc_id, or have none, each get their own.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.probabilities(features_of(text)) for _, texts in _slices(batch.column("text")) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([x[i] for x in found], pa.float64()) for i in range(len(names))]], ["doc_id", *names])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(workers.lean(score), f"doc_id {ids}, " + ", ".join(f"{n} double" for n in names))


def without_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose probability of ``category`` is under ``cut``; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    place = chain.categories.index(category)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        workers.forget()
        return pa.array([model.value.probabilities(features_of(text))[place] for _, some in _slices(texts) for text in some], pa.float64())

    return docs.where(probability("text") < cut)


def labelled_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, low_quality, toxic): the two kinds of fault that ``labels`` (doc_id, quality, toxic) marks.

    At most about ``settings.rows`` labels are taken, so their ids can be broadcast and the texts aren't moved to be joined.
    """
    share = min(1.0, settings.rows / max(labels.count(), 1))
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    marks = some.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


CATEGORIES = ["low_quality", "toxic"]
