"""Rows that surely have none of a set of keys, told apart where they are: only the others need an exact join.

A join of whole texts with a list of keys sends every text to another machine. Here the keys become a bitmap of bounded size
that all executors get. A row whose bit isn't set has none of the keys, for certain, and stays in its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.names import unused

from . import store


@dataclass(frozen=True)
class Sieve:
    """So many words of 64 bits: a million of them are 67 million bits and at most 16 MB of numbers in the broadcast.

    With many more keys than bits nearly every row passes for one that may have a key. Results stay the same; more rows move.
    """

    words: int = 1 << 20


def _place(columns: list[Column], words: int) -> tuple[Column, Column]:
    """The word and the bit of a key. Nulls have a place like any other value."""
    hashed = F.xxhash64(*columns)
    return F.pmod(hashed, F.lit(words)), F.pmod(F.shiftright(hashed, 40), F.lit(64)).cast("int")


def bitmap(keys: DataFrame, sieve: Sieve = Sieve()) -> DataFrame:
    """(word, bits), written, at most ``sieve.words`` rows: a bit for every row of ``keys``. An empty table gives none."""
    word, bit = _place([F.col(f"`{c}`") for c in keys.columns], sieve.words)
    bits = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    return store.written(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")


def parted(frame: DataFrame, key: list[Column], keys: DataFrame, sieve: Sieve = Sieve()) -> tuple[DataFrame, DataFrame]:
    """``frame`` as (rows whose key is surely not in ``keys``, rows whose key may be there).

    ``key`` are columns of ``frame`` of the same number and types as those of ``keys``; null counts as a value. Each row is in one part,
    repeated rows in the same; columns stay as they are.
    """
    marks = bitmap(keys, sieve)
    word_, bits_ = unused(frame.columns, "word", "bits")
    word, bit = _place(key, sieve.words)
    marked = frame.join(F.broadcast(marks.withColumnsRenamed({"word": word_, "bits": bits_})), word == F.col(word_), "left")
    may = F.coalesce(F.call_function("bit_get", F.col(bits_), bit) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in frame.columns]
    return marked.where(~may).select(columns), marked.where(may).select(columns)
