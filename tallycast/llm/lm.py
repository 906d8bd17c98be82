"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

N-grams of any order from two on, over white-space words with a start (as many as there are words of context) and an end. Order + 1 passes over
the texts:

1. every task counts its n-grams' 64-bit hashes; the counts are dealt by ranges of the hash, and each range becomes one sorted array;
2. for each lower length, every task looks its next longer grams up in these arrays. A gram seen c times gives 1/c at each of its places, so the
   sums over the places are numbers of *different* grams: by context (seen once, twice, more often) and by what they end in (what comes before
   it), the count of the lower orders. They are dealt by ranges of the hash and become the arrays of that length;
3. scoring looks up all.

A hot word is one entry of a task's sums, never a group of rows. The number of ranges follows the size of the input,
so no task holds more than its share. Arrays lie in the shared folder; a range that is written again after a lost executor
has the same content.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .neardup import mixed

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: A range of hashes covers about so many bytes of text.
RANGE_BYTES = 16_000_000
#: Tasks sum up over so many bytes of text at a time.
PART_BYTES = 24_000_000


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that belong to the whole model."""

    folder: str
    ranges: int
    order: int = 2
    tokens: int = 0  # training tokens
    types: int = 0  # different ones
    continuations: int = 0  # different bigrams
    #: Discounts of the grams of each length from one on: seen (shorter ones: after different words) once, twice, more often.
    discounts: tuple[tuple[float, float, float], ...] = ()
    lower_seen: tuple[int, int, int] = (0, 0, 0)  # words with one, two, more words before them


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; fixed ones where these are too few to tell."""
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


def tokens_of(texts: list[bytes | None], order: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the tokens of some texts, of the tokens one, two, ... before each, and where each text ends in them."""
    hashes, ends, n = [], [], 0
    for text in texts:
        words = (text or b"").lower().split()
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        hashes.append(np.append(found, END))
        n += len(words) + 1
        ends.append(n)
    if not texts:
        return [np.empty(0, np.uint64)] * order, np.empty(0, np.int64)
    columns = [np.concatenate(hashes)]
    for _ in range(order - 1):
        before = np.concatenate([[START], columns[-1][:-1]])
        before[np.array(ends[:-1], np.int64)] = START
        columns.append(before)
    return columns, np.array(ends)


def pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * PRIME + tokens)


def grams(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of the grams of these tokens, the last one first."""
    key = columns[-1]
    for tokens in columns[-2::-1]:
        key = pairs(key, tokens)
    return key


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to about a megabyte of text."""
    for batch in batches:
        step = max(1, int(len(batch) * 2_000_000 / max(batch.nbytes, 1)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins and ends in sorted ``keys``."""
    bounds = np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def _dealt(keys: np.ndarray, columns: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    at = _ranges(keys, ranges)
    rows = [(i, [c[a:b].tobytes() for c in [keys, *columns]]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["part", "arrays"])


def _counted(ranges: int, order: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0
        for part in _parts(batches):
            have.append(grams(tokens_of(part.column("text").to_pylist(), order)[0]))
            size += part.nbytes
            if size > PART_BYTES:
                yield _dealt(*_unique(have), ranges)
                have, size = [], 0
        if have:
            yield _dealt(*_unique(have), ranges)

    return count


def _unique(have: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, counts = np.unique(np.concatenate(have), return_counts=True)
    return keys, [counts.astype(np.uint32)]


def _merged(rows: pa.Table, kinds: list[type]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All rows' keys once, sorted, with the sums of the columns."""
    arrays = rows.column("arrays").to_pylist()
    keys = np.concatenate([np.frombuffer(x[0], np.uint64) for x in arrays])
    keys, place = np.unique(keys, return_inverse=True)
    sums = []
    for i, kind in enumerate(kinds, 1):
        values = np.concatenate([np.frombuffer(x[i], kind) for x in arrays])
        sums.append(np.bincount(place, values, len(keys)))
    return keys, sums


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """A raw array under its final name only when it's whole."""
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    system.move(own, f"{path}/{name}")


def _load(folder: str, name: str, kind: type) -> np.ndarray:
    """The array, memory-mapped; where the shared folder is no file system of this machine, read."""
    from pyarrow import fs

    system, path = _file_system(folder)
    if isinstance(system, fs.LocalFileSystem):
        there = f"{path}/{name}"
        return np.memmap(there, kind, "r") if os.path.exists(there) and os.path.getsize(there) else np.empty(0, kind)
    if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return np.empty(0, kind)
    with system.open_input_file(f"{path}/{name}") as source:
        return np.frombuffer(source.read(), kind)


def kind_of(length: int) -> type:
    return np.int64 if length == 1 else np.uint32


class Arrays:
    """Lookups in the arrays of a model, opened range by range as they're needed."""

    UPPER = ("count",)
    #: As a gram: its places, and different words before it. As a context: different grams by their count, and the sum of their counts.
    LOWER = ("count", "before", "once", "twice", "more", "total")

    def __init__(self, folder: str, ranges: int, order: int):
        self.folder, self.ranges, self.order, self.open = folder, ranges, order, {}

    def names(self, length: int) -> tuple[str, ...]:
        return self.UPPER if length == self.order else self.LOWER

    def get(self, length: int, part: int) -> dict[str, np.ndarray]:
        if (length, part) not in self.open:
            kinds = {"key": np.uint64} | dict.fromkeys(self.names(length), kind_of(length))
            self.open[length, part] = {k: _load(self.folder, f"{length}-{k}-{part:06d}", kind) for k, kind in kinds.items()}
        return self.open[length, part]

    def find(self, length: int, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The values of sorted ``keys``; 0 for those that aren't there."""
        names = self.names(length)
        out = {name: np.zeros(len(keys), np.int64) for name in names}
        at = _ranges(keys, self.ranges)
        for part in np.flatnonzero(at[1:] > at[:-1]).tolist():
            have, asked = self.get(length, part), keys[at[part] : at[part + 1]]
            if not len(have["key"]):
                continue
            place = np.minimum(np.searchsorted(have["key"], asked), len(have["key"]) - 1)
            there = have["key"][place] == asked
            for name in names:
                out[name][at[part] : at[part + 1]] = np.where(there, have[name][place], 0)
        return out


def _save_upper(folder: str, order: int) -> Callable:
    def save(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, (counts,) = _merged(rows, [np.uint32])
        _save(folder, f"{order}-key-{part:06d}", keys)
        _save(folder, f"{order}-count-{part:06d}", counts.astype(kind_of(order)))
        seen = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
        return pa.table({"n": [len(keys)], **{f"n{i}": [int(seen[i])] for i in range(1, 5)}, "tokens": [int(counts.sum())]})

    return save


def _summed(folder: str, ranges: int, order: int, length: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder, ranges, order)
        have, size = [], 0
        for part in _parts(batches):
            columns, _ = tokens_of(part.column("text").to_pylist(), length + 1)
            longer, place = np.unique(grams(columns), return_inverse=True)
            found = arrays.find(length + 1, longer)
            share = 1.0 / np.maximum(found["count"], 1)[place]
            n = found["count" if length + 1 == order else "before"][place]
            keys, at = np.unique(np.concatenate([grams(columns[:-1]), grams(columns[1:])]), return_inverse=True)
            as_gram, as_context = at[: len(place)], at[len(place) :]
            sums = [np.bincount(as_gram, minlength=len(keys)).astype(float), np.bincount(as_gram, share, len(keys))]
            sums += [np.bincount(as_context, np.where(seen, share, 0), len(keys)) for seen in (n == 1, n == 2, n > 2)]
            have.append((keys, [*sums, np.bincount(as_context, share * n, len(keys))]))
            size += part.nbytes
            if size > PART_BYTES:
                yield _dealt(*_added(have), ranges)
                have, size = [], 0
        if have:
            yield _dealt(*_added(have), ranges)

    return count


def _added(have: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, place = np.unique(np.concatenate([x[0] for x in have]), return_inverse=True)
    return keys, [np.bincount(place, np.concatenate([x[1][i] for x in have]), len(keys)) for i in range(len(have[0][1]))]


def _save_lower(folder: str, length: int) -> Callable:
    def save(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, sums = _merged(rows, [np.float64] * len(Arrays.LOWER))
        sums = [np.rint(x).astype(np.int64) for x in sums]
        _save(folder, f"{length}-key-{part:06d}", keys)
        for name, values in zip(Arrays.LOWER, sums, strict=True):
            _save(folder, f"{length}-{name}-{part:06d}", values.astype(kind_of(length)))
        before = sums[1]
        seen = np.bincount(np.minimum(before, 5), minlength=6)
        out = {"n": [int((sums[0] > 0).sum())], **{f"n{i}": [int(seen[i])] for i in range(1, 5)}, "more": [int((before > 2).sum())], "tokens": [int(before.sum())]}
        return pa.table(out)

    return save


def train(docs: DataFrame, use: Column, order: int = 2) -> Model:
    """A model of the rows of ``docs`` (text) for which ``use`` holds; null texts count as empty ones."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    texts = docs.where(use).select(F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    model = Model(store.new_path(spark, "lm"), max(1, -(-int(size) * (order - 1) // RANGE_BYTES)), order)
    if "://" not in model.folder and not model.folder.startswith("file:"):
        model.folder = "file://" + model.folder
    sums = [F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3", "n4", "tokens")]
    counted = texts.mapInArrow(_counted(model.ranges, order), "part int, arrays array<binary>")
    upper = counted.groupBy("part").applyInArrow(_save_upper(model.folder, order), "n long, n1 long, n2 long, n3 long, n4 long, tokens long").agg(*sums).first()
    if not upper["n"]:
        return model
    levels = [upper]
    for length in range(order - 1, 0, -1):
        summed = texts.mapInArrow(_summed(model.folder, model.ranges, order, length), "part int, arrays array<binary>")
        saved = summed.groupBy("part").applyInArrow(_save_lower(model.folder, length), "n long, n1 long, n2 long, n3 long, n4 long, more long, tokens long")
        levels.insert(0, saved.agg(*sums, F.sum("more").alias("more")).first())
    words = levels[0]
    model.tokens, model.continuations, model.types = upper["tokens"], words["tokens"], words["n"]
    model.discounts = tuple(discounts(*[level[f"n{i}"] for i in range(1, 5)]) for level in levels)
    model.lower_seen = (words["n1"], words["n2"], words["more"])
    return model


class Scorer:
    """Probabilities of tokens after their contexts."""

    def __init__(self, model: Model):
        self.model, self.arrays = model, Arrays(model.folder, model.ranges, model.order)
        seen = model.lower_seen
        self.total = max(model.continuations, 1)
        # What the discounts took is spread over all types and one for all unseen words.
        self.uniform = (sum(x * n for x, n in zip(model.discounts[0], seen, strict=True)) / self.total if model.continuations else 1.0) / (model.types + 1)

    def found(self, length: int, keys: np.ndarray) -> dict[str, np.ndarray]:
        keys, place = np.unique(keys, return_inverse=True)
        return {name: values[place] for name, values in self.arrays.find(length, keys).items()}

    def batch(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Training count and log10 probability of each token."""
        order, d = self.model.order, self.model.discounts or ((0.5, 1.0, 1.5),) * self.model.order
        words = self.found(1, columns[0])
        n = words["before"].astype(float)
        p = np.maximum(n - _discount(n, d[0]), 0) / self.total + self.uniform
        for length in range(2, order + 1):
            c = self.found(length, grams(columns[:length]))["count" if length == order else "before"].astype(float)
            u = {k: v.astype(float) for k, v in self.found(length - 1, grams(columns[1:length])).items()}
            total, cut = u["total"], d[length - 1]
            held = cut[0] * u["once"] + cut[1] * u["twice"] + cut[2] * u["more"]
            # A context that was not seen leaves it to the shorter one.
            p = np.where(total > 0, (np.maximum(c - _discount(c, cut), 0) + held * p) / np.maximum(total, 1), p)
        return words["count"], np.log10(p)


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n <= 0, 0, np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of ``docs``; a null text is an empty one.

    ``score`` is the log10 probability of the text with its end; perplexity is 10 ** (-score / n_tokens). ``base_score`` is that of an
    add-one unigram model of the same training tokens.
    """
    fixed = json.dumps(asdict(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**json.loads(fixed))
        scorer = Scorer(model)
        for part in _parts(batches):
            columns, ends = tokens_of(part.column("text").to_pylist(), model.order)
            if not len(ends):
                continue
            counts, logs = scorer.batch(columns)
            starts = np.concatenate([[0], ends[:-1]])
            base = np.log10((counts + 1) / (model.tokens + model.types + 1))
            out = [pa.array(ends - starts), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(score, f"doc_id {ids}, n_tokens long, n_known long, base_score double, score double")
