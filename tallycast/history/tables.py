"""The four history tables and what a run appends to them.

Keys are hashes of the run and the entity, and a run owns its partition of each table: a task or a whole
run that is repeated writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendars import future_months
from ..functions.text import iso_date
from ..session import cut_lineage
from . import journal

SCHEMAS = {
    "users": (
        "user_id bigint, api_key string, organization string, email string, created_at timestamp, "
        "last_used timestamp, is_active boolean"
    ),
    "uploaded_files": (
        "file_id bigint, user_id bigint, filename string, file_hash string, row_count bigint, n_months bigint, "
        "date_range_start string, date_range_end string, uploaded_at timestamp, run_id string"
    ),
    "predictions": (
        "pred_id bigint, user_id bigint, file_id bigint, model_name string, model_order string, "
        "seasonal_order string, forecast_months int, model_aic double, forecast_json string, "
        "created_at timestamp, run_id string"
    ),
    "anomalies": (
        "anomaly_id bigint, pred_id bigint, anomaly_date string, actual_value double, predicted_value double, "
        "residual double, std_deviations double, severity string, description string, detected_at timestamp, "
        "run_id string"
    ),
}
FORECAST = (
    "dates array<string>, values array<double>, confidence_upper array<double>, confidence_lower array<double>"
)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables that are not there yet."""
    for name, schema in SCHEMAS.items():
        place = "" if name == "users" else " PARTITIONED BY (run_id)"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet{place}")


def open_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a history folder; one that was never written is empty."""
    out = {}
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{name}"
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
        out[name] = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return out


def register_users(users: DataFrame, folder: str) -> None:
    """Append accounts (rows of the ``users`` schema)."""
    users.write.mode("append").parquet(f"{folder}/users")


def forecast_struct():
    """The forecast of a result row in the form that is stored."""
    part = lambda name: F.transform("path", lambda p: p[name])
    dates = F.transform(future_months(F.col("last_month"), F.size("path")), lambda d: iso_date(d))
    return F.struct(
        dates.alias("dates"),
        part("value").alias("values"),
        part("upper").alias("confidence_upper"),
        part("lower").alias("confidence_lower"),
    )


def run_tables(results: DataFrame, run_id: str, user_id: int) -> dict[str, DataFrame]:
    """The rows one run adds to files, predictions and anomalies."""
    run, now = F.lit(run_id), F.current_timestamp()
    done = results.filter(F.col("status") == "ok").withColumn("pred_id", F.xxhash64(run, F.lit("p"), F.col("entity")))
    file_id = F.xxhash64(run, F.lit("f"), F.col("entity"))
    values = F.transform("ys", lambda y: y.cast("string"))
    content = F.concat_ws("\n", F.zip_with("months_axis", values, lambda m, y: F.concat_ws(";", iso_date(m), y)))
    files = done.select(
        file_id.alias("file_id"),
        F.lit(user_id).cast("bigint").alias("user_id"),
        F.concat(F.lit("by_code_"), "entity").alias("filename"),
        F.sha2(content, 256).alias("file_hash"),
        F.col("ledger_rows").cast("bigint").alias("row_count"),
        F.col("n_months"),
        iso_date(F.element_at("months_axis", 1)).alias("date_range_start"),
        iso_date(F.element_at("months_axis", -1)).alias("date_range_end"),
        now.alias("uploaded_at"),
        run.alias("run_id"),
    )
    predictions = done.select(
        "pred_id",
        F.lit(user_id).cast("bigint").alias("user_id"),
        file_id.alias("file_id"),
        F.col("model").alias("model_name"),
        "model_order",
        "seasonal_order",
        F.col("months").cast("int").alias("forecast_months"),
        F.col("aic").alias("model_aic"),
        F.to_json(forecast_struct()).alias("forecast_json"),
        now.alias("created_at"),
        run.alias("run_id"),
    )
    anomalies = done.select("pred_id", F.explode("anomalies").alias("a")).select(
        F.xxhash64("pred_id", "a.date").alias("anomaly_id"),
        "pred_id",
        F.col("a.date").alias("anomaly_date"),
        *[f"a.{c}" for c in ("actual_value", "predicted_value", "residual", "std_deviations", "severity", "description")],
        now.alias("detected_at"),
        run.alias("run_id"),
    )
    return {"uploaded_files": files, "predictions": predictions, "anomalies": anomalies}


def save_run(results: DataFrame, folder: str, run_id: str, user_id: int) -> None:
    """Write one run. A repeated run replaces its own partition and nothing else.

    Three tables come out of the same fitted rows: give a checkpointed or stored ``results`` (see
    ``session.cut_lineage``), or the fits are run once per table.
    """
    for name, rows in run_tables(results, run_id, user_id).items():
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{folder}/{name}")
        )


#: The keys of the tables, and the column whose hash deals their rows into buckets.
KEYS = {
    "users": (["api_key"], "api_key"),
    "uploaded_files": (["run_id", "file_id"], "user_id"),
    "predictions": (["run_id", "pred_id"], "user_id"),
    "anomalies": (["run_id", "anomaly_id"], "pred_id"),
}


def append_users(users: DataFrame, folder: str, batch: str) -> None:
    """Register accounts (rows of the ``users`` schema) once: a key that has an account keeps it, a repeated batch adds nothing."""
    journal.append(users, f"{folder}/users", batch, *KEYS["users"])


def append_run(results: DataFrame, folder: str, run_id: str, user_id: int) -> None:
    """Add one run to files, predictions and anomalies, each as one append; what a broken-off run has committed stays and is not repeated.

    The fitted rows are checkpointed once and feed all three.
    """
    for name, rows in run_tables(cut_lineage(results), run_id, user_id).items():
        journal.append(rows, f"{folder}/{name}", run_id, *KEYS[name])


def committed_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that :func:`append_users` and :func:`append_run` write, with their buckets."""
    return {name: journal.committed(spark, f"{folder}/{name}", schema) for name, schema in SCHEMAS.items()}


def prediction_by_key(found: dict[str, DataFrame], api_key: str, pred_id: int | None = None) -> DataFrame:
    """The predictions of the account that owns a key, or that one of them. One bucket of accounts is read, and that account's of the predictions."""
    account = journal.looked_up(found["users"], "api_key", api_key)
    own = journal.of_these(found["predictions"], account, "user_id")
    return own if pred_id is None else own.where(F.col("pred_id") == pred_id)
