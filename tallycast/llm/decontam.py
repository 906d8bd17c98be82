"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every window of every text.

Built of DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.names import unused

from . import store
from .words import LETTERED, lowered, window_hash, words

WIDTH = 10
#: At most so many windows are broadcast at once (about 60 MB); a larger benchmark is taken in blocks.
BLOCK = 200_000


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(hash, window, items) for every distinct window of the items; a shorter item is one window, an empty one none."""
    worded = benchmark.select("item_id", words(lowered(F.col("text")), LETTERED).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = worded.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(width)).alias("window"))
    items = F.collect_set(F.col("item_id").cast("string")).alias("items")
    return each.groupBy(window_hash("window", F.lit(0), width).alias("hash"), "window").agg(items)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, copies, n_words, found) for each distinct row of ``docs``; found: array of (start, length, items).

    Each text is read once for each block of the benchmark. All its windows are exploded as bare hashes and looked up
    in the broadcast set within the same stage; where a hash is found, the words themselves are compared. Only hits and one row
    for each document leave the stage. ``copies`` counts rows with the same doc_id and text.
    """
    grams = store.written(windows(benchmark, width), "windows")
    shape = grams.groupBy(F.size("window").alias("n")).agg(F.count("*").alias("grams")).collect()  # at most `width` rows
    lengths = sorted({row["n"] for row in shape} | {width})
    blocks = max(1, -(-sum(row["grams"] for row in shape) // block))
    text = F.col("text")
    worded = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(lowered(text), LETTERED).alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - 1)

    def hashes_of(n: int) -> Column:
        return F.transform(starts, lambda i: window_hash("w", i, n))

    hashes = [hashes_of(n) for n in lengths]
    nothing = F.array().cast("array<bigint>")
    # The null at the end matches nothing; it stands for the document itself.
    hashed = worded.withColumn("h", F.concat(F.when(F.size("w") > 0, F.concat(*hashes)).otherwise(nothing), F.array(F.lit(None).cast("bigint"))))
    parts = []
    for number in range(blocks):
        some = grams.where(F.pmod("hash", F.lit(blocks)) == number)
        # The outer form: for the plain one Spark tests the array's size first, below the words' projection, and reads the words again for each.
        exploded = hashed.select("doc_id", "text_hash", "w", F.posexplode_outer("h").alias("at", "hash"))
        met = exploded.join(F.broadcast(some), "hash", "left")
        itself = F.col("at") == F.size("w") * len(lengths)
        start = F.col("at") % F.greatest(F.size("w"), F.lit(1)) + 1
        same = F.when(F.col("window").isNotNull(), F.slice("w", start, F.size("window")) == F.col("window")).otherwise(False)
        met = met.where(same | itself)
        hit = F.when(same, F.struct(start.alias("start"), F.size("window").alias("length"), "items"))
        parts.append(met.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), hit.alias("hit"), F.when(itself & F.lit(number == 0), 1).alias("one")))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy("doc_id", "text_hash").agg(F.count("one").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("found"))


def covered(found: Column) -> Column:
    """How many words lie inside at least one of the (start, length, ...) spans."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(have: Column, span: Column) -> Column:
        last = span["start"] + span["length"] - 1
        fresh = F.greatest(last - F.greatest(have["end"], span["start"] - 1), F.lit(0))
        return F.struct(F.greatest(have["end"], last).alias("end"), (have["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(found), state, step, lambda have: have["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of ``docs``.

    Null and empty texts have no words and no hits. Benchmark items with a null id are looked for but not counted as items.
    """
    found = hits(docs, benchmark, width, block)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))
    out = found.select("doc_id", "copies", "n_words", covered(F.col("found")).cast("long").alias("n_hit"), items.alias("items"))
    out = out.select("doc_id", "copies", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; all columns stay."""
    bad = store.written(hits(docs, benchmark, width, block).where(F.size("found") > 0).select("doc_id", "text_hash"), "contaminated")
    id_, hash_ = unused(docs.columns, "id", "hash")
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    same = docs["doc_id"].eqNullSafe(bad[id_]) & (F.xxhash64(docs["text"]) == bad[hash_])
    return docs.join(bad, same, "left_anti")


def without_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; what stands between words goes with the word before it."""
    found = store.written(hits(docs, benchmark, width, block).where(F.size("found") > 0).select("doc_id", "text_hash", "found"), "passages")
    id_, hash_, found_ = unused(docs.columns, "id", "hash", "found")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("found").alias(found_))
    same = docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(docs["text"]) == found[hash_])
    gaps = "([" + LETTERED[2:-2] + "]*)"  # what stands between words
    piece = F.regexp_extract_all("text", F.lit(f"({LETTERED}[{LETTERED[2:-2]}]*)"), F.lit(1))
    head = F.regexp_extract("text", "^" + gaps, 1)
    inside = lambda i: F.exists(found_, lambda x: (i + 1 >= x["start"]) & (i + 1 < x["start"] + x["length"]))
    cut = F.concat(head, F.array_join(F.filter(piece, lambda _, i: ~inside(i)), ""))
    columns = [F.when(F.col(found_).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else docs[c] for c in docs.columns]
    return docs.join(found, same, "left").select(columns)
