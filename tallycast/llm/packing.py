"""Best-fit packing of documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, workers


@dataclass(frozen=True)
class Tokens:
    """The tokenizer's file (on every machine), the sequence length and the id that ends a document."""

    path: str
    length: int = 2048
    end: int = 0
    #: A worker remembers the ids of up to twice so many white-space separated strings, from task to task, until other work comes to it.
    remembered: int = 300_000


#: A run of letters, then one of ASCII punctuation: as many pieces for the tokenizer as of these aren't empty.
SIMPLE = re.compile(r"([^\W\d_]*)([!-/:-@\[-`{-~]*)")


class Words:
    """Ids of white-space separated strings as bytes. The tokenizer never joins what white space parts, so each is encoded once.

    The strings asked for lately are kept in two generations; when the younger is full, the older is forgotten.
    """

    def __init__(self, tokens: Tokens):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(tokens.path), tokens.remembered
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """After this, ``young`` has all of ``words``."""
        fresh = words.difference(self.young)
        if len(self.young) + len(fresh) > self.most:
            self.old, self.young = self.young, {}
            fresh = words
        unknown = []
        for w in fresh:
            known = self.old.get(w)
            if known is None:
                unknown.append(w)
            else:
                self.young[w] = known
        for at in range(0, len(unknown), 100):
            self._encode(unknown[at : at + 100])

    def _encode(self, words: list[bytes]) -> None:
        """Simple strings are encoded together: each of their pieces ends with a token that ends a word."""
        simple, counts, others = [], [], []
        for w in words:
            text = w.decode()
            if text.isalpha():
                simple.append(w)
                counts.append(1)
            elif match := SIMPLE.fullmatch(text):
                simple.append(w)
                counts.append(bool(match[1]) + bool(match[2]))
            else:
                others.append(w)
        ids = self._ids(b" ".join(simple).decode())
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == sum(counts):
            stops = ends[np.cumsum(counts) - 1].tolist() if counts else []
            whole = ids.tobytes()
            for w, start, stop in zip(simple, [0, *stops][:-1], stops, strict=True):
                self.young[w] = whole[4 * start : 4 * stop]
        else:  # a letter that isn't one for the tokenizer
            others = words
        for w in others:
            self.young[w] = self._ids(w.decode()).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        """Without the places in the text, which take the tokenizer time."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def _pieces(tokens: Tokens):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = workers.kept(tokens, lambda: Words(tokens))
        end = np.array([tokens.end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                words = [(text or b"").split() for text in part.column("text").to_pylist()]
                known.learn(set().union(*words))
                rows = []
                for place, some in enumerate(words):
                    ids = b"".join([*map(known.young.__getitem__, some), end])
                    for piece, start in enumerate(range(0, len(ids), 4 * tokens.length)):
                        cut_ids = ids[start : start + 4 * tokens.length]
                        rows.append((place, piece, start // 4, len(cut_ids) // 4, zlib.crc32(cut_ids)))
                place, *rest = zip(*rows, strict=True)
                columns = [part.column("doc_id").take(pa.array(place, pa.int64())), *[pa.array(x, kind) for x, kind in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32), written: every document's ids with the end id, cut only where they're too many."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(workers.lean(_pieces(tokens), tokens), f"doc_id {ids}, piece int, start long, length long, ids_crc32 long")
    return store.written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")


@dataclass(frozen=True)
class Search:
    """Pieces are packed in blocks of about ``block``; what is in underfull sequences is packed again with that of other blocks."""

    block: int = 4096
    #: A sequence with at most so much room is left as it is between rounds.
    slack: int = 32


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room left, bin), ascending
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect_left(gaps, (size, -1))
        if at == len(gaps):
            bins.append([item])
            insort(gaps, (room - size, len(bins) - 1))
        else:
            gap, b = gaps.pop(at)
            bins[b].append(item)
            if gap > size:
                insort(gaps, (gap - size, b))
    return bins


class Underfull:
    """Local search on the bins of a block that aren't full; every step moves tokens from an emptier bin to a fuller one.

    So the sum of squared fills grows with every step, and bins run empty. The steps: a document moves to another bin, or is
    exchanged for one shorter document or for two that are shorter together.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, room: int):
        self.bins, self.lengths, self.room = bins, lengths, room
        self.fills = np.array([lengths[b].sum() for b in bins], np.int64)

    def run(self) -> list[list[int]]:
        """Takes the emptiest bin that can still give, until none can or no bin could be saved."""
        stuck: set[int] = set()
        fresh = True
        while True:
            open_ = np.flatnonzero((self.fills > 0) & (self.fills < self.room))
            free = self.room * len(open_) - self.fills[open_].sum()
            givers = [b for b in open_[np.argsort(self.fills[open_], kind="stable")].tolist() if b not in stuck]
            if free < self.room or len(open_) < 2 or not givers:
                return [b for b in self.bins if b]
            if fresh:
                self._list(open_)
            fresh = self._give(givers[0])
            if not fresh:
                stuck.add(givers[0])

    def _list(self, open_: np.ndarray) -> None:
        """What the open bins could hand back: nothing, one document, or two of their documents."""
        rows = []
        for b in open_.tolist():
            items = self.bins[b]
            rows.append((0, b, -1, -1))
            rows += [(self.lengths[i], b, i, -1) for i in items]
            # Of very many short documents in one bin, each is paired with the next only.
            pairs = itertools.combinations(items, 2) if len(items) <= 24 else itertools.pairwise(items)
            rows += [(self.lengths[i] + self.lengths[j], b, i, j) for i, j in pairs]
        self.back = np.array(rows, np.int64)
        self.listed = self.fills.copy()

    def _give(self, giver: int) -> bool:
        """Steps from ``giver`` to bins that haven't changed since they were listed, each the one that moves most; False if there was none."""
        moved_any = False
        back, taker = self.back[:, 0], self.back[:, 1]
        while self.fills[giver]:
            best = (0, -1, -1)
            gaps = self.room - self.fills[taker]
            usable = (self.fills[taker] == self.listed[taker]) & (taker != giver) & (self.fills[taker] >= self.fills[giver])
            for item in self.bins[giver]:
                moves = self.lengths[item] - back
                good = np.where(usable & (moves > 0) & (moves <= gaps), moves, 0)
                at = int(np.argmax(good))
                if good[at] > best[0]:
                    best = (int(good[at]), item, at)
            moved, item, at = best
            if not moved:
                return moved_any
            other, *returned = self.back[at, 1:].tolist()
            returned = [i for i in returned if i >= 0]
            self.bins[giver] = [i for i in self.bins[giver] if i != item] + returned
            self.bins[other] = [i for i in self.bins[other] if i not in returned] + [item]
            self.fills[giver] -= moved
            self.fills[other] += moved
            moved_any = True
        return moved_any


def _packed(room: int):
    def pack(block: pa.Table) -> pa.Table:
        rows = block.sort_by("row")
        lengths, ids = rows.column("length").to_numpy(), rows.column("row").to_numpy()
        out = np.empty((len(ids), 3), np.int64)
        for items in Underfull(best_fit(lengths, room), lengths, room).run():
            sizes = lengths[items]
            out[items, 0] = ids[items].min()
            out[items, 1] = np.cumsum(sizes) - sizes
            out[items, 2] = sizes.sum()
        return pa.table({"row": ids, "length": lengths, "sequence_id": out[:, 0], "offset": out[:, 1], "filled": out[:, 2]})

    return pack


def packed(docs: DataFrame, tokens: Tokens, search: Search = Search()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each row of ``docs``.

    A null or empty text is the end id alone. Pieces as long as a sequence are one each. The others are dealt into blocks, each
    packed by best fit and local search; what lies in underfull sequences is dealt anew into fewer blocks, until one
    block is left. So no task sees more than a few blocks' pieces, and at most one block's sequences stay underfull for want of partners.
    """
    cut = pieces(docs, tokens)
    whole = cut.where(F.col("length") == tokens.length).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool, done = cut.where(F.col("length") < tokens.length).select("row", "length"), whole
    left, before = pool.count(), None
    while left:
        # Where a round ended less than an eighth of the pieces, they fit no better: the next is the last.
        last = left <= search.block or (before is not None and left > before * 7 // 8)
        blocks = -(-left // search.block)
        block = F.pmod(F.xxhash64("row", F.lit(left)), F.lit(blocks)).alias("block")
        found = pool.select("row", "length", block).groupBy("block").applyInArrow(_packed(tokens.length), "row long, length long, sequence_id long, offset long, filled long")
        found = store.written(found, "packed")
        full = F.lit(True) if last else F.col("filled") >= tokens.length - search.slack
        done = done.union(found.where(full).select("row", "sequence_id", "offset"))
        if last:
            break
        pool = found.where(~full).select("row", "length")
        before, left = left, pool.count()
    return cut.join(done, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
