"""Statistics of whole texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import window_hash, words

WINDOW = 8


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) for each row.

    Null counts as empty. Lines are those with a word. A window of 8 words that occurs twice in a text makes all words inside its
    occurrences count, the first included.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(*keep, text.alias("_text"), words(text).alias("_words"), lines.alias("_lines"))
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    hashes = F.when(F.size("_words") >= WINDOW, F.transform(starts, lambda i: window_hash("_words", i, WINDOW)))
    counts = read.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_hashes"),
    )
    # Sorted only where some window occurs twice.
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.when(again, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counts = counts.withColumn("_placed", placed)
    beside = lambda x, j, step: F.coalesce(F.get("_placed", j + step)["h"] == x["h"], F.lit(False))
    twice = F.filter("_placed", lambda x, j: beside(x, j, 1) | beside(x, j, -1))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    state = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))

    def cover(have: Column, i: Column) -> Column:
        last = i + WINDOW - 1
        return F.struct(last.alias("end"), (have["n"] + last - F.greatest(have["end"], i - 1)).alias("n"))

    repeated = F.coalesce(F.aggregate(places, state, cover, lambda have: have["n"]), F.lit(0)).cast("long")
    return counts.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))
