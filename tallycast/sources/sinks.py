"""Result tables as files, partitioned by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_date, money_text, safe_key
from ..history.journal import BUCKET, BUCKETS, bucket_of, looked_up
from ..operators import series
from ..plans import pipeline
from ..session import cut_lineage


def split_by_entity(ledger: DataFrame, folder: str) -> None:
    """One folder of ``date;montant`` files per entity, summed per day.

    The rows of an entity were brought together by the daily sum; an entity is at most its days, so one
    file per entity is small. Two keys that look alike as file names stay apart by the original key.
    """
    daily = series.daily_sum(ledger)
    rows = daily.select(
        safe_key(F.col("entity")).alias("entity_key"),
        "entity",
        iso_date(F.col("date")).alias("date"),
        F.col("amount").cast("double").alias("montant"),
    )
    ordered = series.spread(rows).sortWithinPartitions("entity_key", "entity", "date")
    writer = ordered.write.mode("overwrite").partitionBy("entity_key", "entity")
    writer.option("sep", ";").option("header", True).csv(folder)


def write_forecasts(forecasts: DataFrame, folder: str) -> None:
    """Forecast files per entity, with the established column names. Two keys that look alike as file names stay apart by
    the original key, the inner folder."""
    # Column names of the forecast files.
    rows = forecasts.select(
        safe_key(F.col("entity")).alias("entity_key"),
        "entity",
        iso_date(F.col("month")).alias("date"),
        F.col("value").alias("prévision"),
        F.col("lower").alias("min_confiance"),
        F.col("upper").alias("max_confiance"),
    )
    rows.write.mode("overwrite").partitionBy("entity_key", "entity").option("header", True).csv(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    summary.select(F.col("entity").alias("ordonateur"), "status", "out_path").write.mode("overwrite").option(
        "header", True
    ).csv(folder)


def formatted_export(forecasts: DataFrame) -> DataFrame:
    """The forecast as text: thousands separators, two decimals, N/A for a missing bound."""
    return forecasts.select(
        "entity",
        iso_date(F.col("month")).alias("date"),
        money_text(F.col("value")).alias("value_text"),
        money_text(F.col("lower")).alias("min_text"),
        money_text(F.col("upper")).alias("max_text"),
    )


def write_export(forecasts: DataFrame, folder: str) -> None:
    formatted_export(forecasts).write.mode("overwrite").option("sep", ";").option("header", True).csv(folder)


def write_documents(results: DataFrame, folder: str) -> None:
    """One JSON document per entity and line."""
    results.select("entity", pipeline.result_document().alias("d")).select("entity", "d.*").write.mode(
        "overwrite"
    ).json(folder)


def run_batch(ledger: DataFrame, folder: str, months: int = 12, rule: str = "classic", limit: int | None = None) -> None:
    """Forecast every entity and write forecasts, anomalies, documents and the run summary.

    The fitted rows are checkpointed once and feed all writes; an entity without a model gets its row in the
    summary and stops nothing.
    """
    from ..operators import clean

    if limit is not None:
        ledger = clean.first_entities(ledger, limit)
    results = cut_lineage(pipeline.forecast_ledger(ledger, months=months, rule=rule))
    write_forecasts(pipeline.forecast_rows(results), f"{folder}/forecasts")
    pipeline.anomaly_rows(results).write.mode("overwrite").parquet(f"{folder}/anomalies")
    write_documents(results, f"{folder}/documents")
    write_summary(pipeline.run_summary(results, f"{folder}/forecasts/entity_key="), f"{folder}/summary")


def write_indexed(rows: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Rows of millions of entities in a few files a bucket, with a table of where each entity lies: (entity, file, first_row, n_rows).

    A folder per entity, as above, is as many files as entities; here the files follow the buckets, an entity's rows lie together in its
    bucket's files, and one with a third of all rows is split over several. The index is a pass over the written keys alone.
    """
    dealt = rows.withColumn(BUCKET, bucket_of(F.col("entity"), buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "entity")
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/rows")
    written = rows.sparkSession.read.parquet(f"{folder}/rows")
    places = written.select(BUCKET, "entity", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    index = places.groupBy(BUCKET, "entity", "file").agg(F.min("at").alias("first_row"), F.count("*").alias("n_rows"))
    index.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "entity").write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/index")


def read_indexed(spark: SparkSession, folder: str, entity: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of one entity: one bucket of the index, then only the files it names; their row groups of other entities are passed over."""
    index = spark.read.parquet(f"{folder}/index")
    found = looked_up(index, "entity", entity, buckets).select("file", "first_row", "n_rows").collect()  # a row for each file that holds it
    if not found:
        return spark.read.parquet(f"{folder}/rows").limit(0).drop(BUCKET)
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(*[f["file"] for f in found])
    at, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    here = F.lit(False)
    for f in found:
        here |= (file == f["file"]) & at.between(f["first_row"], f["first_row"] + f["n_rows"] - 1)
    return rows.where((F.col("entity") == entity) & here).drop(BUCKET)
