"""Phrase collocations, counted by direct address in tiles of frequency-ranked ids.

Words get ids by their frequency, so pairs of frequent words meet in few tiles of the id-by-id plane. A task counts a tile in which it has many
pairs by one dense ``bincount``, and the pairs of all sparser tiles by sorting them. Pairs that are frequent in the whole corpus are
ranked anew and take the part of the first word for phrases of three words, and so on.

The passes:

1. a task cuts its texts into blocks of one language, each with its own dictionary and counts; the counts of all blocks give the words' frequencies;
2. words frequent enough for a phrase are ranked; their ids go back to the blocks that hold them, by (block, word), so no worker ever holds
   the whole dictionary;
3. for every length, tasks count the phrases of their blocks, and the counts meet by phrase. A word or phrase that holds a third of all
   rows is one row of each block. Phrases whose parts aren't frequent are left out with the help of a bitmap of fixed size; what it lets
   pass in error isn't frequent either and goes by its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.operators.places import numbered

from . import store
from .neardup import mixed

PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Mining:
    """What is a candidate, which are dropped, and how counts are laid out."""

    longest: int = 3
    least: int = 10
    #: A candidate goes if a longer one that holds it has this percentage of its occurrences.
    percent: int = 50
    scale: int = 1_000_000
    best: int = 2000
    #: A block is about so many bytes of text.
    block_bytes: int = 8_000_000
    #: Ids below 2^dense_bits are counted in tiles of 2^tile_bits by 2^tile_bits, where a tile has at least a 32nd as many pairs as cells.
    dense_bits: int = 16
    tile_bits: int = 10
    #: The bitmap of frequent phrases has 2^bitmap_bits bits.
    bitmap_bits: int = 26
    #: Each language's candidates are cut to the best in so many parts before the parts meet.
    parts: int = 16


#: A-Z in lower case; what ends a piece becomes a full stop.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
UNKNOWN = "und"


class _Ids(dict):
    """Words in the order in which they were first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def ids_of(texts: list[bytes], ids: _Ids) -> np.ndarray:
    """The ids of the texts' words; 0 is the end of a piece."""
    parts = []
    for text in texts:
        # Only blanks and tabs are left to split at.
        found = text.translate(_FOLD).replace(b".", b" . ").split()
        found.append(b".")
        parts.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
    return np.concatenate(parts)


def _blocks(mining: Mining):
    """Rows (lang, ids, words, counts) of about ``block_bytes`` of text in one language."""

    def one(lang: str, held: tuple[list[np.ndarray], _Ids]) -> pa.RecordBatch:
        parts, ids = held
        tokens = np.concatenate(parts)
        counts = np.bincount(tokens, minlength=len(ids))
        arrays = [pa.array([lang]), pa.array([tokens.tobytes()]), pa.array([list(ids)], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "ids", "words", "counts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[np.ndarray], _Ids]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            step = max(1, int(len(batch) * 1_000_000 / max(batch.nbytes, 1)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in set(langs):
                    mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    if lang not in held:
                        held[lang], sizes[lang] = ([], _Ids({b".": 0})), 0
                    held[lang][0].append(ids_of(mine, held[lang][1]))
                    sizes[lang] += sum(map(len, mine)) + len(mine)
                if sum(sizes.values()) > mining.block_bytes:  # of all languages
                    largest = max(sizes, key=sizes.get)
                    yield one(largest, held.pop(largest))
                    sizes.pop(largest)
        for lang, have in held.items():
            yield one(lang, have)

    return cut


def blocks(docs: DataFrame, mining: Mining) -> DataFrame:
    """(block, lang, ids, words, counts), written: ``ids`` are places in ``words``, as little-endian 32-bit integers."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    made = rows.mapInArrow(_blocks(mining), "lang string, ids binary, words array<binary>, counts array<long>")
    return store.written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def vocabulary(cut: DataFrame, mining: Mining) -> tuple[DataFrame, DataFrame]:
    """(word_id, lang, word, f) of the words frequent enough, written, the most frequent with id 0; and (lang, n) of all words."""
    listed = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    listed = store.written(listed.where(F.col("word") != F.lit(b".")).groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    frequent = listed.where(F.col("f") >= mining.least)
    ranked = numbered(frequent, F.col("f").desc(), F.col("lang"), F.col("word"), name="word_id", cut=lambda f: store.written(f, "ranked"))
    ranked = store.written(ranked.withColumn("word_id", F.col("word_id") - 1), "vocabulary")
    return ranked, listed.groupBy("lang").agg(F.sum("f").alias("n"))


def encoded(cut: DataFrame, words: DataFrame) -> DataFrame:
    """(ids, global_ids, places), written: each block's ids with the frequent words' global ones and their places in the block's own."""
    listed = cut.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = listed.join(words.select("lang", "word", "word_id"), ["lang", "word"]).groupBy("block")
    known = known.agg(F.collect_list(F.struct("place", "word_id")).alias("known"))
    both = cut.select("block", "ids").join(known, "block")
    return store.written(both.select("ids", F.col("known.place").alias("places"), F.col("known.word_id").alias("global_ids")), "encoded")


def slots(columns: list[np.ndarray], mining: Mining) -> np.ndarray:
    """The bits of phrases in the bitmap."""
    key = np.zeros(len(columns[0]), np.uint64)
    for ids in columns:
        key = mixed(key * PRIME + ids.astype(np.uint64) + np.uint64(1))
    return (key & np.uint64((1 << mining.bitmap_bits) - 1)).astype(np.int64)


def tiled(left: np.ndarray, right: np.ndarray, mining: Mining) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of pairs of ids that are all below 2^dense_bits: (left, right, count), tile by tile."""
    if len(left) == 0:
        return (np.empty(0, np.int64),) * 3
    bits, low = mining.tile_bits, (1 << mining.tile_bits) - 1
    tile = (left >> bits << (mining.dense_bits - bits)) | (right >> bits)
    order = np.argsort(tile, kind="stable")
    cell = ((left & low) << bits | (right & low))[order]
    tiles, starts = np.unique(tile[order], return_index=True)
    cells, counts, of = [], [], []
    sparse = np.ones(len(cell), bool)
    for t, a, b in zip(tiles.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
        if (b - a) << 5 >= 1 << (2 * bits):
            dense = np.bincount(cell[a:b], minlength=1 << (2 * bits))
            seen = np.flatnonzero(dense)
            cells.append(seen)
            counts.append(dense[seen])
            of.append(np.full(len(seen), t))
            sparse[a:b] = False
    # The sparse tiles as coordinates, sorted.
    rest, n = np.unique(tile[order][sparse] << (2 * bits) | cell[sparse], return_counts=True)
    cells.append(rest & ((1 << (2 * bits)) - 1))
    counts.append(n)
    of.append(rest >> (2 * bits))
    cell, count, tile = map(np.concatenate, (cells, counts, of))
    across = mining.dense_bits - bits
    return (tile >> across) << bits | cell >> bits, (tile & ((1 << across) - 1)) << bits | cell & low, count


def _counted_rows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of some columns and how often each occurs, by sorting."""
    if len(columns[0]) == 0:
        return columns, np.empty(0, np.int64)
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
    starts = np.flatnonzero(new)
    return [c[starts] for c in ordered], np.diff(np.append(starts, len(order)))


def _phrases(length: int, mining: Mining, shared):
    """Rows (w0, w1, ..., n) of the phrases of ``length`` words in each block. ``shared``: the frequent phrases that are one word shorter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, top = shared.value if shared else (None, None)
        for batch in batches:
            for row in range(len(batch)):
                own = np.frombuffer(batch.column("ids")[row].as_buffer(), np.int32)
                names = np.full(int(own.max(initial=0)) + 1, -1, np.int64)
                names[np.asarray(batch.column("places")[row].values)] = np.asarray(batch.column("global_ids")[row].values)
                columns, n = phrases_in(names[own], length, mining, bitmap, top)
                for at in range(0, len(n), 250_000):
                    arrays = [pa.array(c[at : at + 250_000]) for c in [*columns, n]]
                    yield pa.RecordBatch.from_arrays(arrays, [*_names(length), "n"])

    return count


def phrases_in(ids: np.ndarray, length: int, mining: Mining, bitmap: np.ndarray | None, top: list[np.ndarray] | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases of ``length`` words and their counts; -1 among ``ids`` ends a phrase.

    ``bitmap`` has the frequent phrases of one word less, ``top`` the most frequent of them in their order.
    """
    n = len(ids) - length + 1
    if n <= 0:
        return [np.empty(0, np.int64)] * length, np.empty(0, np.int64)
    good = np.logical_and.reduce([ids[i : i + n] >= 0 for i in range(length)])
    if length > 2:
        at = np.flatnonzero(np.logical_and.reduce([ids[i : i + n + 1] >= 0 for i in range(length - 1)]))
        shorter = np.zeros(n + 1, bool)
        slot = slots([ids[at + i] for i in range(length - 1)], mining)
        shorter[at] = bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
        good &= shorter[:-1] & shorter[1:]
    at = np.flatnonzero(good)
    words = [ids[at + i] for i in range(length)]
    left = words[0] if length == 2 else _ranks(words[:-1], top)
    dense = (left >= 0) & (left < 1 << mining.dense_bits) & (words[-1] < 1 << mining.dense_bits)
    a, b, counts = tiled(left[dense], words[-1][dense], mining)
    first = [a] if length == 2 else [column[a] for column in top]
    rest, rest_counts = _counted_rows([w[~dense] for w in words])
    return [np.concatenate(pair) for pair in zip([*first, b], rest, strict=True)], np.concatenate([counts, rest_counts])


def _ranks(words: list[np.ndarray], top: list[np.ndarray]) -> np.ndarray:
    """The rank of each phrase among the ``top`` ones, -1 for others."""
    if len(top[0]) == 0:
        return np.full(len(words[0]), -1, np.int64)
    # A phrase is found by its hash and then compared; one that is missed only goes the way of the rarer ones.
    key = lambda columns: slots(columns, Mining(bitmap_bits=62))
    known = key(top)
    order = np.argsort(known, kind="stable")
    at = np.minimum(np.searchsorted(known[order], key(words)), len(order) - 1)
    rank = order[at]
    same = np.logical_and.reduce([column[rank] == w for column, w in zip(top, words, strict=True)])
    return np.where(same, rank, -1)


def _names(length: int) -> list[str]:
    return [f"w{i}" for i in range(length)]


def _shared(frequent: DataFrame, length: int, mining: Mining):
    """The bitmap of the frequent phrases and the most frequent of them in their order, both of bounded size, for all workers."""
    key = frequent.select(*_names(length)).mapInArrow(_slots_of(length, mining), "byte long, bits long")
    bits = key.groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros(1 << (mining.bitmap_bits - 6), np.int64)
    for batch in bits.toArrow().to_batches():
        bitmap[batch.column("byte").to_numpy()] = batch.column("bits").to_numpy()
    ranked = numbered(frequent, F.col("n").desc(), *map(F.col, _names(length)), cut=lambda f: store.written(f, "ranked"))
    top = ranked.where(F.col("place") <= 1 << mining.dense_bits).toArrow().sort_by("place")
    ranked = [top.column(c).to_numpy() for c in _names(length)]
    return frequent.sparkSession.sparkContext.broadcast((bitmap.view(np.uint8), ranked))


def _slots_of(length: int, mining: Mining):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots([c.to_numpy() for c in batch.columns], mining)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["byte", "bits"])

    return of


def counted(texts: DataFrame, length: int, mining: Mining, shared=None) -> DataFrame:
    """(w0, w1, ..., n) of the phrases of ``length`` words frequent enough, written."""
    schema = ", ".join(f"{c} long" for c in [*_names(length), "n"])
    found = texts.mapInArrow(_phrases(length, mining, shared), schema)
    found = found.groupBy(*_names(length)).agg(F.sum("n").alias("n")).where(F.col("n") >= mining.least)
    return store.written(found, f"phrases{length}")


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of every language of ``docs`` (text, lang; more columns don't matter).

    A-Z is lower-cased, texts are split at ``.,;:!?`` and line breaks into pieces and these at blanks and tabs into words. Candidates have 2 to
    ``longest`` words and at least ``least`` occurrences, overlaps included. Cut after its first k words a candidate of ``a`` occurrences has
    the score floor(scale * a * a / (l * r)), l and r the occurrences of the parts; the least cut counts, the first of equal ones. A
    candidate goes if a longer candidate that holds it has ``percent`` of its occurrences. ``n`` are all words of the language.

    Numbers are exact up to 10^16 occurrences. A null language is ``und``; null and empty texts have no words,
    rows that repeat count again; equal scores stand by occurrences and then by phrase in byte order. A language without candidates has no
    rows, an empty table gives none.
    """
    cut = blocks(docs, mining)
    words, totals = vocabulary(cut, mining)
    texts = encoded(cut, words)
    by_length, shared = {}, None
    for length in range(2, mining.longest + 1):
        by_length[length] = counted(texts, length, mining, shared)
        if length < mining.longest:
            shared = _shared(by_length[length], length, mining)
    named = store.written(_united([_scored(by_length, n, words, mining) for n in by_length]), "candidates")
    return _ranked(named, totals, mining)


def _united(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _scored(by_length: dict[int, DataFrame], length: int, words: DataFrame, mining: Mining) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of ``length`` words that no longer one makes needless."""
    names = _names(length)
    found = by_length[length]
    covers = [
        longer.select(*[F.col(f"w{at + i}").alias(f"w{i}") for i in range(length)], F.col("n").alias("cover"))
        for size, longer in by_length.items()
        if size > length
        for at in range(size - length + 1)
    ]
    if covers:
        cover = store.written(_united(covers).groupBy(*names).agg(F.max("cover").alias("cover")), "covers")
        found = found.join(cover, names, "left").where(F.col("cover").isNull() | (100 * F.col("cover") < mining.percent * F.col("n"))).drop("cover")
    for i in range(length):
        word = words.select(F.col("word_id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}_1"), *([F.col("lang")] if i == 0 else []))
        found = found.join(word, f"w{i}")
    for size in range(2, length):
        for at in (0, length - size):
            part = by_length[size].select(*[F.col(f"w{i}").alias(f"w{at + i}") for i in range(size)], F.col("n").alias(f"f{at}_{size}"))
            found = found.join(part, [f"w{at + i}" for i in range(size)])
    cuts = F.array(*[_cut(k, F.col(f"f0_{k}"), F.col(f"f{k}_{length - k}"), mining) for k in range(1, length)])
    phrase = F.concat_ws(" ", *[F.col(f"t{i}").cast("string") for i in range(length)])
    least = found.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), F.array_min(cuts).alias("cut"))
    return least.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def _cut(k: int, l: Column, r: Column, mining: Mining) -> Column:  # noqa: E741
    wide = lambda x: x.cast("decimal(38,0)")
    a = wide(F.col("n"))
    score = F.call_function("div", wide(F.lit(mining.scale)) * a * a, wide(l) * wide(r))
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))


def _ranked(candidates: DataFrame, totals: DataFrame, mining: Mining) -> DataFrame:
    """The best of each language: first of each of some parts, then of these."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(mining.parts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= mining.best)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= mining.best)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
