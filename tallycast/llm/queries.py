"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, importance, lm, mixing, neardup, packing, phrases, pii, quality_rules, quality_trees, toxicity, urls, warc
from .store import crc_of_id, table


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(toxicity.labelled_documents(docs, table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return toxicity.scored(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = urls.judged(pages, urls.outcomes_of(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_trees.scored(docs, labels, crc_of_id() % 3 == 1)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def language_model(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs, crc_of_id() % 7 != 2, order)
    out = lm.scored(docs, model)
    return out.select("doc_id", (crc_of_id() % 7 == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def trigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(spark, sf_dir, 3)


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), packing.Tokens(public_tokenizers.path("word_bpe_49k.json")))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = F.get("takes", F.lit(0))
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", take["target"].alias("target"), take["taken"].alias("taken"))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity_chain": toxic_documents,
    "op2_host_reputation": url_reputation,
    "op3_near_duplicates": near_duplicates,
    "op4_controlled_rules": controlled_rules,
    "op5_rule_ensemble": rule_ensemble,
    "op6_personal_data": personal_data,
    "op7_warc_round_trip": warc_round_trip,
    "op8_benchmark_hits": benchmark_hits,
    "op9_language_model": language_model,
    "op10_packed_sequences": packed_sequences,
    "op11_collocations": collocations,
    "op12_source_mix": source_mix,
    "op13_importance_resampling": importance_resampling,
}

#: Further forms of an operator, registered beside its query.
FORMS = {"op9_trigram_model": trigram_model}
