"""Importance resampling to a target distribution, drawn by a distributed quickselect.

A document's features are hashed into buckets; the target's and the corpus' counts of a bucket give its gain, and a document's weight is the sum over an
array of gains. Weight and Gumbel noise make a key; the k-th largest key is found by counting on which side of random pivot keys
the rows fall, without sorting them. Only the rows drawn are sorted and ranked.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.operators.places import numbered

from . import store


@dataclass(frozen=True)
class Features:
    """Runs of one to ``longest`` words, hashed by CRC-32 into ``buckets``."""

    longest: int = 3
    buckets: int = 10_000


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with at least ``least_words`` words, by noise of ``seed``; ``pivots`` keys a round."""

    percent: int = 5
    least_words: int = 20
    seed: int = 42
    pivots: int = 24


#: A-Z in lower case, everything that is no letter, digit or part of a non-ASCII character a space.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FOLD = np.frombuffer(_FOLDED, np.uint8)
#: CRC-32 of single bytes, without the inversions before and after.
_BYTE = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
#: Words up to so many bytes are hashed together, longer ones one by one.
SHORT = 32


def _shift_one(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint32(8)) ^ _BYTE[x & np.uint32(255)]


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map of a (4, 256) table, byte by byte."""
    return table[0, x & np.uint32(255)] ^ table[1, (x >> np.uint32(8)) & np.uint32(255)] ^ table[2, (x >> np.uint32(16)) & np.uint32(255)] ^ table[3, x >> np.uint32(24)]


@functools.cache
def shift(n: int) -> np.ndarray:
    """The (4, 256) table that carries the checksum of a text over ``n`` bytes behind it: crc(a + b) = shift(len(b))(crc(a)) ^ crc(b)."""
    if n == 0:
        return np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    half = shift(n // 2)
    whole = _apply(half, half)
    return _shift_one(whole) if n % 2 else whole


@functools.cache
def _shifts() -> np.ndarray:
    return np.stack([shift(n) for n in range(SHORT + 1)]).astype(np.uint32)


def followed(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of texts followed by others: ``left`` and ``right`` are theirs, ``lengths`` those of the right ones in bytes."""
    few, tables = np.minimum(lengths, SHORT), _shifts()
    out = tables[few, 0, left & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ tables[few, i, (left >> np.uint32(8 * i)) & np.uint32(255)]
    for n in np.unique(lengths[lengths > SHORT]).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = _apply(shift(n), left[at])
    return out ^ right


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and lengths of the words of texts that lie one after another, and how many words each text has.

    ``bounds`` are the texts' ends, with the first one's start before them.
    """
    folded = _FOLD[data]
    inside = folded != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]  # two texts never share a word
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return folded, starts, lengths, np.diff(np.searchsorted(starts, bounds))


def word_checksums(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of every word: the k-th byte of all words that have one is taken at once."""
    clipped = np.minimum(lengths, SHORT)
    order = np.argsort(-clipped, kind="stable")
    at = starts[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    counts = len(order) - np.cumsum(np.bincount(clipped, minlength=SHORT + 1))[:SHORT]  # words of more than k bytes
    for k, n in enumerate(counts.tolist()):
        if n == 0:
            break
        state[:n] = _BYTE[(state[:n] ^ folded[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = zlib.crc32(folded[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def buckets_of(data: np.ndarray, bounds: np.ndarray, features: Features) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of one, two, ... words: their buckets and the number of the text each is in; and the words of each text."""
    folded, starts, lengths, n_words = words_of(data, bounds)
    single = word_checksums(folded, starts, lengths)
    text = np.repeat(np.arange(len(n_words)), n_words)
    space = np.uint32(zlib.crc32(b" "))
    run, buckets, texts = single, [], []
    for n in range(1, features.longest + 1):
        if n > 1:
            joined = followed(run[:-1], np.full(max(len(run) - 1, 0), space), np.ones(max(len(run) - 1, 0), np.int64))
            run = followed(joined, single[n - 1 :], lengths[n - 1 :])
        within = text[: len(run)] == text[n - 1 :][: len(run)]
        buckets.append((run[within] % np.uint32(features.buckets)).astype(np.int64))
        texts.append(text[: len(run)][within])
    return buckets, texts, n_words


def _slices(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``size`` bytes of text; a longer text is one slice."""
    for batch in batches:
        step = max(1, int(len(batch) * size / max(batch.nbytes, 1)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and their bounds, without a copy; null is empty."""
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _histogram(features: Features):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for part in _slices(batches):
            for found in buckets_of(*_bytes(part.column("text")), features)[0]:
                total += np.bincount(found, minlength=features.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    return count


def _texts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def histogram(rows: DataFrame, features: Features) -> list[int]:
    """How many features of all texts fall into each bucket. Tasks send a row for each bucket, the driver gets one."""
    counts = _texts(rows).mapInArrow(_histogram(features), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * features.buckets
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """A thousandth of a nat each: how much likelier a bucket is in the target, with one feature more in every bucket of both."""
    s_all, t_all, k = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(corpus, target, strict=True)]


def _weighed(features: Features, gain: list[int]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = np.array(gain, np.int64)
        for part in _slices(batches):
            buckets, texts, n_words = buckets_of(*_bytes(part.column("text")), features)
            weight, n = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for found, text in zip(buckets, texts, strict=True):
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(part)))])
                sums = np.concatenate([[0], np.cumsum(of_bucket[found])])
                weight += sums[at[1:]] - sums[at[:-1]]
                n += np.diff(at)
            arrays = [part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (n_words, n, weight)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def scored(docs: DataFrame, target: DataFrame, features: Features, draw: Draw) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document, written."""
    gain = gains(histogram(docs, features), histogram(target, features))
    ids = docs.schema["doc_id"].dataType.simpleString()
    made = _texts(docs, "doc_id").mapInArrow(_weighed(features, gain), f"doc_id {ids}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    made = made.withColumn("score", (F.col("weight") + noise).cast("long"))
    return store.written(made.withColumn("row", F.monotonically_increasing_id()), "scored")


#: Keys in their order: a larger score first, then the smaller doc_id, null last. Rows that are equal in it are told apart by their number.
_KEY = ("score", "doc_id", "row")


def _before(score, doc_id, row) -> Column:
    """Whether a row stands before a key in the order of :data:`_KEY`."""
    id_ = F.col("doc_id")
    earlier = (id_.isNotNull() if doc_id is None else F.coalesce(id_ < F.lit(doc_id), F.lit(False)))
    same = id_.eqNullSafe(F.lit(doc_id))
    return (F.col("score") > score) | ((F.col("score") == score) & (earlier | (same & (F.col("row") < row))))


def _is(score, doc_id, row) -> Column:
    return (F.col("score") == score) & F.col("doc_id").eqNullSafe(F.lit(doc_id)) & (F.col("row") == row)


def selected(rows: DataFrame, k: int, draw: Draw) -> tuple | None:
    """The k-th key of ``rows`` (score, doc_id, row), None for k = 0.

    Each round takes random keys from what is left as pivots and counts the rows before and at each of them; the k-th key is one of these, or lies
    between two, and only the rows there are looked at next. Every round is one scan with partial counts, and about as many
    times fewer rows are left as there are pivots.
    """
    low, high, skipped, round_ = None, None, 0, 0
    while k:
        left = (~_before(*low) & ~_is(*low) if low else F.lit(True)) & (_before(*high) if high else F.lit(True))
        round_ += 1
        chance = F.xxhash64(F.lit(draw.seed), F.lit(round_), "row")
        pivots = [tuple(r) for r in rows.where(left).orderBy(chance).limit(draw.pivots).select(*_KEY).collect()]
        pivots.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2]))
        sides = rows.where(left).agg(*[F.count_if(_before(*p)) for p in pivots], *[F.count_if(_is(*p)) for p in pivots]).first()
        base, above = skipped, high
        for pivot, before, at in zip(pivots, sides, sides[len(pivots) :], strict=False):
            if base + before < k <= base + before + at:
                return pivot
            if base + before + at < k:
                low, skipped = pivot, base + before + at
            elif high == above:
                high = pivot
    return None


def resampled(docs: DataFrame, target: DataFrame, features: Features = Features(), draw: Draw = Draw()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for every row of ``docs`` (doc_id, text; more columns don't matter).

    ``rank`` is 1, 2, 3, ... for the documents drawn, by score and then by doc_id, and null for the others. Null and empty texts have no features and
    weight 0. Rows without a doc_id get the noise of an empty number and come last among equal scores. Rows that repeat a doc_id are drawn one by one; which of several with equal
    score and doc_id comes first is open. An empty corpus gives an empty table; with an empty target every feature only loses.
    """
    rows = scored(docs, target, features, draw)
    able = rows.where(F.col("n_words") >= draw.least_words)
    last = selected(able.select(*_KEY), able.count() * draw.percent // 100, draw)
    if last is None:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= draw.least_words) & (_before(*last) | _is(*last))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    out = ["doc_id", "n_features", "weight", "score"]
    winners = numbered(rows.where(drawn).select(*out, "row"), *order, name="rank", cut=lambda f: store.written(f, "drawn"))
    others = rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return winners.select(*out, F.col("rank").cast("long")).unionByName(others)
