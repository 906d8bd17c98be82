"""MinHash near-duplicates by a multi-index Hamming join."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.functions.names import unused

from . import graph, sieve, store, workers

SHINGLE = 5


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; one for the whole of a shorter text, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    rolled = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(rolled)])
    return np.unique(rolled + np.uint64(width))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Index:
    """How signatures are made and split.

    ``slots`` minimum hashes of 16 bits are split into ``chunks``. Two signatures that differ in at most ``threshold``
    slots differ in at most ``errors`` slots of some chunk, so they share one of the chunk's keys: the slots that
    are left when any ``errors`` of them are masked. With the defaults a pair of similarity 0.75 differs in 12 slots on
    average; that none of its chunks has at most one error happens in 1 of 10 million cases.
    """

    slots: int = 48
    chunks: int = 12
    threshold: int = 23
    #: Bits of the parity sketch of a set, a multiple of 64.
    bits: int = 2048
    seed: int = 7

    @property
    def errors(self) -> int:
        return self.threshold // self.chunks

    def masks(self) -> list[tuple[int, ...]]:
        """The slots of each key."""
        out = []
        for chunk in np.array_split(np.arange(self.slots), self.chunks):
            out += [tuple(int(i) for i in left) for left in itertools.combinations(chunk, len(chunk) - self.errors)]
        return out

    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**63, self.slots, np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        least = np.full(self.slots, np.iinfo(np.uint64).max)
        factors = self.factors()[:, None]
        for at in range(0, len(shingles), block):
            least = np.minimum(least, (shingles[None, at : at + block] * factors).min(axis=1))
        return (mixed(least) >> np.uint64(48)).astype(np.uint16)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A row of 64-bit keys for each signature."""
        out = np.empty((len(signatures), len(self.masks())), np.uint64)
        for i, left in enumerate(self.masks()):
            key = np.full(len(signatures), i + 1, np.uint64)
            for slot in left:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, slot])
            out[:, i] = key
        return out


def sketch(shingles: np.ndarray, bits: int) -> list[int]:
    """For each bit, whether an odd number of shingles fall on it. Where two sketches differ, one set has a shingle the other lacks."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_link(percent: int, bits: int) -> Column:
    """False only if two sets, of columns n, s0, s1, ... and m, t0, t1, ..., can't have 100 * intersection >= percent * union.

    Then at most (100 - percent) / (100 + percent) of all their shingles are in one set only, and the sketches can't differ in more bits.
    The sketches are plain columns, as this is asked of every two nodes that meet.
    """
    apart = reduce(add, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(bits // 64)])
    m, n = F.col("m"), F.col("n")
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (apart * (100 + percent) <= (100 - percent) * (m + n))


def _read_sets(index: Index):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sizes, classes, signatures, sketches = [], [], [], []
            for text in part.column("text").to_pylist():
                shingles = shingle_set(text)
                sizes.append(len(shingles))
                classes.append(hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None)
                signatures.append(index.signature(shingles).tobytes() if len(shingles) else None)
                sketches.append(sketch(shingles, index.bits) if len(shingles) else None)
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "signature", "sketch"])

    return signed


def _keyed(index: Index):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(len(batch), index.slots)
            keys = index.keys(signatures.astype(np.uint64))
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], ["key", "node"])

    return keyed


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``size`` bytes, as what is made of them takes many times their size."""
    for batch in batches:
        step = max(1, int(len(batch) * size / max(batch.nbytes, 1)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        found = [shingle_set(text) for text in part.column("text").to_pylist()]
        classes = [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["class", "shingles"])


def signed(docs: DataFrame, index: Index) -> DataFrame:
    """(row, doc_id, n_shingles, class, signature, sketch) for each document, written: a row keeps its number from here on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = rows.mapInArrow(workers.lean(_read_sets(index)), "doc_id long, n_shingles long, class binary, signature binary, sketch array<long>")
    return store.written(made.withColumn("row", F.monotonically_increasing_id()), "signed")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(wanted, "node").select("node", "class", "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ids = wanted.select("doc_id").distinct()
    # Texts that can't be wanted don't move.
    _, rows = sieve.parted(rows, [F.col("doc_id")], ids)
    texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    # Other rows can have the same doc_id or the same set; one of each set is enough.
    sets = texts.mapInArrow(workers.lean(_sets), "class binary, shingles array<long>").join(wanted, "class").dropDuplicates(["node"]).select("node", "shingles")
    sets = store.written(sets, "sets")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    both = F.size(F.array_intersect("left", "right"))
    return joined.where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, index: Index = Index()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; more columns don't matter).

    Words are split at ASCII white space and A-Z lower-cased; two documents are linked if their sets of distinct five-word
    shingles have 100 * intersection >= percent * union. ``component_id`` is the smallest doc_id reachable over links.

    1. Rows of equal sets are one node from the start, so a group of copies of any size is one row of the join.
    2. Multi-index Hamming join: every node has the keys of its signature's chunks (see :class:`Index`). First each node is held
       against one node of each of its keys, another for every key, not against all of them.
    3. A key whose nodes are all in one component by then can add nothing. For the others, nodes outside the key's largest
       component are held against all nodes of other components, so no link between components is lost.

    Of what meets under a key only pairs that :func:`may_link` can't rule out leave the join; their full sets are compared then.

    Null or empty texts have no shingles, no links and their own doc_id as component. Null doc_ids count as largest; a
    component of nothing else has a null id, and its rows are kept. Rows that repeat a doc_id are judged on their own.
    """
    rows = signed(docs, index)
    merged = components_of(docs, rows, percent, index)
    out = rows.select("doc_id", "n_shingles", "class").join(merged, "class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "class")


def components_of(docs: DataFrame, rows: DataFrame, percent: int, index: Index) -> DataFrame:
    """(class, root, component_id) for every distinct set; sets of one component share a root."""
    first = rows.where("n_shingles > 0").groupBy("class").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    own = rows.select(F.col("row").alias("node"), "doc_id", "signature", "sketch", F.col("n_shingles").alias("size"))
    nodes = store.written(first.join(own, "node"), "nodes")
    links, roots = _links(docs, nodes, percent, index)
    ids = nodes.join(roots, "node", "left").select("class", "least", F.coalesce("root", "node").alias("root"))
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return ids.join(named, "root").select("class", "root", "component_id")


def _links(docs: DataFrame, nodes: DataFrame, percent: int, index: Index) -> tuple[DataFrame, DataFrame]:
    """(a, b) links that join all components, and (node, root) of the linked nodes."""
    keyed = nodes.select("node", "signature").mapInArrow(workers.lean(_keyed(index)), "key long, node long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sketches = [F.col("sketch")[i].alias(f"s{i}") for i in range(index.bits // 64)]
    members = keyed.join(shared, "key").join(nodes.select("node", F.col("size").alias("n"), *sketches), "node")
    members = store.written(members, "members")

    first = store.written(_star(members, percent, index), "pairs")
    links = store.written(confirmed(docs, nodes, first, percent), "links")
    roots = store.written(graph.components(links), "roots")

    apart = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = store.written(_rest(apart, percent, index), "pairs").join(first, ["a", "b"], "left_anti")
    if rest.isEmpty():
        return links, roots
    links = links.union(store.written(confirmed(docs, nodes, store.written(rest, "pairs"), percent), "links"))
    return links, store.written(graph.components(links), "roots")


def _other_side(members: DataFrame, index: Index) -> DataFrame:
    """The same columns under the names of the other set."""
    names = {"node": "other", "n": "m"} | {f"s{i}": f"t{i}" for i in range(index.bits // 64)}
    return members.withColumnsRenamed(names)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _star(members: DataFrame, percent: int, index: Index) -> DataFrame:
    """Each node of a key with one node of that key: that with the least hash of both."""
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node"), "node")).alias("hub")).select("key", F.col("hub.node").alias("node"))
    hubs = _other_side(hubs.join(members, ["key", "node"]), index).withColumnRenamed("key", "_key")
    return _pairs(members.join(hubs, (F.col("key") == F.col("_key")) & (F.col("node") != F.col("other")) & may_link(percent, index.bits)))


def _rest(apart: DataFrame, percent: int, index: Index) -> DataFrame:
    """Each node outside its key's largest component with every node of the key's other components."""
    counts = apart.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = counts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("roots"))
    largest = largest.where("roots > 1").select("key", F.col("top.root").alias("top"))
    open_ = store.written(apart.join(largest, "key"), "apart")
    outside = _other_side(open_.where("root <> top"), index).drop("top").withColumnsRenamed({"root": "other_root", "key": "_key"})
    # Of two nodes outside, one direction is enough.
    once = (F.col("root") != F.col("other_root")) & ((F.col("root") == F.col("top")) | (F.col("other") < F.col("node")))
    return _pairs(open_.join(outside, (F.col("key") == F.col("_key")) & once & may_link(percent, index.bits)))


def kept_documents(docs: DataFrame, percent: int = 75, index: Index = Index()) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: the one with the smallest doc_id, null last. Columns stay as they are.

    A row is known by its doc_id and its set of shingles, so rows that share a doc_id, or have none, go only as near-duplicates of one that
    stays. Rows without words all stay. Rows that are surely alone with their doc_id and stay don't move (see :mod:`sieve`).
    """
    rows = signed(docs, index)
    merged = components_of(docs, rows, percent, index).select("class", "root")
    by_root = rows.where("n_shingles > 0").select("doc_id", "class").join(merged, "class").groupBy("root")
    heads = by_root.agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "class")).alias("head")).select("head.doc_id", "head.class")
    heads = store.written(heads, "heads")
    id_, set_, head_set = unused(docs.columns, "id", "set", "head_set")
    key = F.col("doc_id").cast("long")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    stays = heads.select("doc_id").union(rows.where("n_shingles = 0").select("doc_id"))
    stays = stays.distinct().select(F.col("doc_id").alias("kept_id"), F.lit(True).alias("stays"))
    counts = counts.join(stays, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left").select("doc_id", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    counts = store.written(counts, "kept-ids")
    alone, docs = sieve.parted(docs, [key], counts.where((F.col("n") > 1) | ~F.col("stays")).select("doc_id"))
    counts = counts.where("stays")
    # Where a doc_id stands for one row, it decides; elsewhere the row's own set does.
    single = docs.join(counts.where("n = 1").select(F.col("doc_id").alias(id_)), key.eqNullSafe(F.col(id_)), "left_semi")
    repeated = docs.join(counts.where("n > 1").select(F.col("doc_id").alias(id_)), key.eqNullSafe(F.col(id_)), "left_semi")
    repeated = repeated.withColumn(set_, class_of(F.col("text").cast("binary")))
    chosen = heads.select(F.col("doc_id").alias(id_), F.col("class").alias(head_set))
    chosen = repeated.join(chosen, key.eqNullSafe(F.col(id_)) & (F.col(set_) == F.col(head_set)), "left_semi").dropDuplicates(["doc_id", set_])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.union(single).union(repeated.where(F.col(set_).isNull()).select(columns)).union(chosen.select(columns))


@F.arrow_udf(T.BinaryType())
def class_of(texts: pa.Array) -> pa.Array:
    workers.forget()
    return pa.array([hashlib.md5(x.tobytes()).digest() if len(x) else None for x in (shingle_set(text.as_py()) for text in texts)], pa.binary())
