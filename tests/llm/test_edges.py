"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallycast.llm import decontam, importance, lm, mixing, neardup, packing, phrases, pii, quality_rules, quality_trees, toxicity, urls, warc
from tallycast.llm.store import crc_of_id

LABELS = "doc_id long, quality int, toxic int"
TOKENS = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (None, 1, None), (6, 1, 0), (6, 1, 0), (99, 0, 0)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "over the lazy dog and runs far away from here"), (None, "one"), (3, None), (4, ""), (5, "ONE")]
    return spark.createDataFrame(rows, "item_id long, text string")


def chain_of(docs, labels):
    return toxicity.fit(toxicity.labelled_documents(docs, labels), toxicity.CATEGORIES)


def test_near_duplicates(odd_documents, no_documents):
    rows = neardup.near_duplicates(odd_documents).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert by_id[8]["component_id"] == 7
    assert [by_id[i]["component_id"] for i in (3, 4, 5)] == [3, 4, 5] and by_id[4]["n_shingles"] == 0
    kept = neardup.kept_documents(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 9] and ids.count(None) == 2
    assert neardup.near_duplicates(no_documents).count() == 0 and neardup.kept_documents(no_documents).count() == 0


def test_benchmark(odd_documents, no_documents, benchmark):
    rows = decontam.report(odd_documents, benchmark).collect()
    assert len(rows) == 12
    found = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in rows if r["doc_id"] is not None}
    assert found[1] == found[2] == (10, 1) and found[7] == (1, 1) and found[4] == (0, 0)
    assert {r["doc_id"] for r in decontam.without_contaminated(odd_documents, benchmark).collect()} == {3, 4, 5, 6, 9, None}
    cut = {r["doc_id"]: r["text"] for r in decontam.without_passages(odd_documents, benchmark).collect()}
    assert cut[1] == "the quick brown fox jumps today" and cut[7] == "" and cut[3] is None
    assert decontam.report(no_documents, benchmark).count() == 0
    assert decontam.report(odd_documents, benchmark.limit(0)).where("contaminated").count() == 0


def test_benchmark_in_blocks(odd_documents, benchmark):
    whole = {tuple(r) for r in decontam.report(odd_documents, benchmark).collect()}
    assert {tuple(r) for r in decontam.report(odd_documents, benchmark, block=1).collect()} == whole


def test_personal_data(odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in pii.report(odd_documents).collect() if r["doc_id"] is not None}
    assert (rows[9]["n_email"], rows[9]["n_ip"], rows[3]["spans"], rows[4]["spans"]) == (1, 1, "", "")
    text = {r["doc_id"]: r["text"] for r in pii.masked(odd_documents).collect()}
    assert text[9] == "Été 中文 \U0001f600 mail <EMAIL> or <IP> now" and text[3] is None
    assert pii.report(odd_documents).count() == 12 and pii.masked(odd_documents).count() == 12
    assert pii.report(no_documents).count() == 0 and pii.masked(no_documents).count() == 0


def test_toxicity(odd_documents, no_documents, labels):
    chain = chain_of(odd_documents, labels)
    assert toxicity.scored(odd_documents, chain).count() == 12
    assert toxicity.without_toxic(odd_documents, chain).columns == odd_documents.columns
    nothing = chain_of(no_documents, labels.limit(0))
    assert toxicity.without_toxic(odd_documents, nothing).count() == 12
    assert toxicity.scored(no_documents, nothing).count() == 0


def test_quality(odd_documents, no_documents, labels):
    rows = {r["doc_id"]: r for r in quality_rules.judged(odd_documents, labels).collect()}
    assert rows[3]["base_failed"] and rows[4]["n_words"] == 0 and rows[6]["n_words"] == 30_000
    # All but the first and last few words of a text of period 997 lie in windows that come again.
    assert rows[6]["n_repeat_words"] == 30_000
    assert quality_rules.judged(odd_documents, labels).count() == 12
    assert quality_rules.judged(no_documents, labels.limit(0)).count() == 0
    scores = quality_trees.scored(odd_documents, labels, crc_of_id() % 3 == 1).collect()
    assert len(scores) == 12 and all(0 <= r["score"] <= 1 for r in scores)
    assert quality_trees.scored(no_documents, labels, crc_of_id() % 3 == 1).count() == 0


def test_language_model(odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in lm.scored(odd_documents, lm.train(odd_documents, F.lit(True))).collect()}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == 1 and rows[6]["n_tokens"] == 30_001
    assert all(r["score"] <= 0 and r["n_known"] == r["n_tokens"] for r in rows.values())
    empty = lm.train(no_documents, F.lit(True))
    assert lm.scored(odd_documents, empty).count() == 12 and lm.scored(no_documents, empty).count() == 0


def test_packing(odd_documents, no_documents):
    rows = packing.packed(odd_documents, TOKENS).collect()
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) > 30_000
    assert packing.packed(no_documents, TOKENS).count() == 0


def test_pages(spark):
    rows = [(1, "http://A.example.net/en/1", "x"), (2, None, "x"), (3, "nothing", None), (4, "http://b.org", ""), (None, "x://y/\r\nz", "x"), (2, None, "x"), (6, "a://", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("n", F.lit(1))
    back = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    assert back == sorted([("1", "revisit", 2, 1), ("2", "response", None, 1), ("2", "response", None, 1), ("3", "revisit", 4, 0), ("4", "response", None, 0), ("None", "revisit", 2, 1), ("6", "response", None, 200_000)])
    outcomes = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "page_id long, faulty int")
    judged = urls.judged(pages, outcomes).collect()
    assert len(judged) == 7 and {r["host"] for r in judged} == {"a.example.net", "", "b.org", "y"}
    assert {r["rule"] for r in judged} == {"example.net/en/", None}
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert urls.judged(pages.limit(0), outcomes.limit(0)).count() == 0


CLASHES = ("_id", "_hash", "_class", "_group", "all", "found", "more", "text_hash", "id", "set", "head_set", "hash", "row", "n", "place", "takes", "source_size")


@pytest.fixture(scope="module")
def clashing_documents(odd_documents):
    return odd_documents.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_near_duplicates_lose_no_row(spark):
    """Rows that share a doc_id, or have none, are kept unless they are copies."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g h", "i j k l m n o p"]
    rows = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in neardup.kept_documents(docs).collect()) == sorted(texts)
    more = docs.union(docs).union(spark.createDataFrame([(4, texts[0]), (6, texts[2]), (None, ""), (None, None)], docs.schema))
    kept = [(r["doc_id"], r["text"]) for r in neardup.kept_documents(more).collect()]
    assert sorted(kept, key=str) == sorted([(4, texts[0]), (5, texts[1]), (6, texts[2]), (None, texts[3]), (None, ""), (None, None)], key=str)


def test_extra_columns_keep_their_values(clashing_documents, odd_documents, labels, benchmark):
    stages = [
        lambda docs: toxicity.without_toxic(docs, chain_of(odd_documents, labels)),
        neardup.kept_documents,
        lambda docs: decontam.without_contaminated(docs, benchmark),
        lambda docs: decontam.without_passages(docs, benchmark),
        pii.masked,
    ]
    for stage in stages:
        out = stage(clashing_documents)
        assert out.columns == clashing_documents.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
        plain = stage(odd_documents).collect()
        assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in plain)


def test_phrases(spark, odd_documents, clashing_documents, no_documents):
    assert phrases.collocations(no_documents).count() == 0
    found = [tuple(r) for r in phrases.collocations(clashing_documents).collect()]
    assert found == [tuple(r) for r in phrases.collocations(odd_documents).collect()]
    # word0 word1 ... word996 again and again: every pair has a trigram of as many occurrences, or one less.
    assert {r[0] for r in found} == {"en"} and len(found) == 997 and all(len(r[2].split()) == 3 for r in found)
    few = phrases.Mining(least=2)
    docs = spark.createDataFrame([(None, "a b. A b! c d"), (None, "c\td c d"), ("und", "x"), ("en", "c d"), ("en", None)], "lang string, text string")
    rows = sorted(tuple(r) for r in phrases.collocations(docs, few).collect())
    # (c d) 3 times, (d c) once; (a b) twice; n = 11 words without a language, or of und.
    assert rows == [("und", 1, "c d", 3, 3, 3, 11, 1_000_000), ("und", 2, "a b", 2, 2, 2, 11, 1_000_000)]


def test_mixing(odd_documents, clashing_documents, no_documents):
    rows = mixing.mixed(odd_documents).collect()
    assert len(rows) == 12 and mixing.mixed(no_documents).count() == 0
    assert sorted(map(str, mixing.mixed(clashing_documents).collect())) == sorted(map(str, rows))
    by_source = {r["source"]: r["source_size"] for r in rows}
    assert by_source == {"a": 48, "b": 30_000, "c": 9 + 1 + 1 + 8, None: 0}
    assert all(r["takes"][0]["taken"] <= 3 * r["size"] for r in rows)


def test_importance(spark, odd_documents, clashing_documents, no_documents, benchmark):
    rows = importance.resampled(odd_documents, benchmark).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == 12 and by_id[3]["n_features"] == by_id[4]["weight"] == 0 and by_id[6]["n_features"] == 3 * 30_000 - 3
    assert all(r["rank"] is None for r in rows)  # a twentieth of one document that is long enough is none
    every = importance.Draw(percent=100, least_words=0, pivots=2)
    ranked = importance.resampled(clashing_documents, benchmark, draw=every).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 13))
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted(ranked, key=lambda r: r["rank"])]
    assert order == sorted(order)
    assert importance.resampled(no_documents, benchmark).count() == 0
    assert importance.resampled(odd_documents, benchmark.limit(0)).count() == 12


def test_pipeline_keeps_columns(spark, odd_documents, labels, benchmark, tmp_path):
    for name, rows in (("documents", odd_documents), ("labels", labels), ("benchmark", benchmark)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_documents.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_a_hot_host_does_not_hide_small_bad_ones(spark):
    """One host of a third of all pages leaves the spread of the others as it is."""
    rows = [(f"h{i}.example.com", 10, 1) for i in range(900)] + [(f"b{i}.example.com", 10, 10) for i in range(100)] + [("x.example.com", 8, 8)]

    def bound(rows):
        counts = spark.createDataFrame(rows, "host string, n long, k long")
        found = urls.shrunk(counts).where("host = 'x.example.com'")
        return found.select(urls.lower_bound(F.col("alpha"), F.col("beta"), urls.Prior().z)).first()[0]

    alone, beside = bound(rows), bound([*rows, ("hot.example.com", 5000, 500)])
    assert alone > 0.5 and beside > 0.5 and abs(alone - beside) < 0.05
