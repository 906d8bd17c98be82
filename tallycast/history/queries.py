"""Listings and statistics over the history tables.

Counts are taken per account before they are joined to the accounts, so an account that owns a third of all
predictions is summed where its rows are read. Joins carry no broadcast hint: the planner broadcasts a side
by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import date_range_text, hash_preview
from .tables import FORECAST


def account(users: DataFrame, api_key: str) -> DataFrame:
    """The account that owns a key."""
    return users.filter(F.col("api_key") == api_key)


def owned(facts: DataFrame, users: DataFrame) -> DataFrame:
    """The facts of the given accounts."""
    return facts.join(users.select("user_id"), "user_id", "left_semi")


def anomalies_with_owner(anomalies: DataFrame, predictions: DataFrame) -> DataFrame:
    """Anomalies with the account of their prediction."""
    return anomalies.join(predictions.select("pred_id", "user_id"), "pred_id", "inner")


def usage_counts(users: DataFrame, files: DataFrame, predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per account: files, ledger rows, predictions, anomalies by severity."""
    by_file = files.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("files_uploaded"), F.sum("row_count").alias("total_rows_processed")
    )
    # Anomalies are counted per prediction first: the join then meets one row per prediction.
    severity = F.col("severity")
    by_prediction = anomalies.groupBy("pred_id").agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.count_if(severity == "HIGH").alias("high"),
        F.count_if(severity == "MEDIUM").alias("medium"),
    )
    made = predictions.select("pred_id", "user_id").join(by_prediction, "pred_id", "left")
    by_account = made.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("predictions_made"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies_detected"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        F.coalesce(F.sum("medium"), F.lit(0)).alias("medium"),
    )
    joined = users.join(by_file, "user_id", "left").join(by_account, "user_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    counted = joined.select(
        *users.columns,
        *[
            zero(c)
            for c in ("files_uploaded", "total_rows_processed", "predictions_made", "anomalies_detected", "high", "medium")
        ],
    )
    return counted.withColumn("low", F.col("anomalies_detected") - F.col("high") - F.col("medium"))


def account_info(users: DataFrame, files: DataFrame, predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Accounts with their three counts."""
    return usage_counts(users, files, predictions, anomalies).select(
        "user_id",
        "organization",
        "is_active",
        "created_at",
        "last_used",
        "files_uploaded",
        "predictions_made",
        "anomalies_detected",
    )


def list_files(files: DataFrame) -> DataFrame:
    """Files with safe defaults, the start of the hash, and the date range as text."""
    return files.select(
        "user_id",
        "file_id",
        F.coalesce("filename", F.lit("(unknown)")).alias("filename"),
        hash_preview(F.col("file_hash")).alias("file_hash"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        "date_range_start",
        "date_range_end",
        date_range_text(F.col("date_range_start"), F.col("date_range_end")).alias("date_range"),
        "uploaded_at",
    )


def list_predictions(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "user_id",
        "pred_id",
        F.col("model_name").alias("model"),
        F.col("model_order").alias("order"),
        "forecast_months",
        F.col("model_aic").alias("aic"),
        "created_at",
    )


def prediction_detail(predictions: DataFrame, anomalies: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Predictions with the stored forecast parsed back and their anomalies as one list.

    A prediction has at most one anomaly per month of its series, so the list stays short.
    """
    chosen = predictions.filter(wanted) if wanted is not None else predictions
    items = anomalies.groupBy("pred_id").agg(
        F.count(F.lit(1)).alias("anomalies_count"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("anomaly_date").alias("date"),
                    F.col("actual_value").alias("actual"),
                    F.col("predicted_value").alias("predicted"),
                    "residual",
                    "std_deviations",
                    "severity",
                    "description",
                )
            )
        ).alias("anomalies"),
    )
    joined = chosen.join(items, "pred_id", "left")
    return joined.select(
        "user_id",
        "pred_id",
        F.col("model_name").alias("model"),
        F.col("model_order").alias("order"),
        "seasonal_order",
        "forecast_months",
        F.col("model_aic").alias("aic"),
        F.from_json("forecast_json", FORECAST).alias("forecast"),
        F.coalesce("anomalies_count", F.lit(0)).alias("anomalies_count"),
        "anomalies",
        "created_at",
    )


def list_anomalies(anomalies: DataFrame, predictions: DataFrame, severity: str | None = None) -> DataFrame:
    """Anomalies with their account, of one severity if asked."""
    rows = anomalies if severity is None else anomalies.filter(F.col("severity") == severity)
    return anomalies_with_owner(rows, predictions).select(
        "user_id",
        "anomaly_id",
        "pred_id",
        F.col("anomaly_date").alias("date"),
        F.col("actual_value").alias("actual"),
        F.col("predicted_value").alias("predicted"),
        "residual",
        "std_deviations",
        "severity",
        "description",
    )


def model_usage(predictions: DataFrame) -> DataFrame:
    """How often each account used each model."""
    return predictions.groupBy("user_id", "model_name").agg(F.count(F.lit(1)).alias("uses"))


def top_models(predictions: DataFrame, best: int = 3) -> DataFrame:
    """The most used models of each account; equal counts go by name."""
    order = W.partitionBy("user_id").orderBy(F.desc("uses"), "model_name")
    ranked = model_usage(predictions).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= best)


def model_statistics(predictions: DataFrame) -> DataFrame:
    """Use of each model over all accounts."""
    return predictions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("uses"),
        F.avg("model_aic").alias("mean_aic"),
        F.avg("forecast_months").alias("mean_months"),
    )


def usage_overview(users: DataFrame, files: DataFrame, predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The whole overview of an account in one row, with its top models in order."""
    models = (
        top_models(predictions)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.col("model_name").alias("model"), "uses"))).alias("models"))
    )
    used = F.transform("models", lambda m: F.struct(m["model"].alias("model"), m["uses"].alias("uses")))
    return (
        usage_counts(users, files, predictions, anomalies)
        .join(models, "user_id", "left")
        .withColumn("models_used", used)
        .drop("models", "api_key", "email")
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """Contents that were uploaded more than once, with the first file that brought them."""
    return (
        files.filter(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count_distinct("user_id").alias("owners"),
            F.min("file_id").alias("first_file_id"),
        )
        .filter(F.col("copies") > 1)
    )
