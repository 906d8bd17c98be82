"""History tables filled from the given tables, and the questions asked of them.

Customers are the accounts, orders are both the uploaded files and the predictions, line items are the
residuals among which the anomalies are found by the rule of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..history import queries as history
from ..history import journal, tables
from ..operators import anomaly
from ..plans import pipeline
from ..session import cut_lineage, shared_folder
from ..sources import sinks
from .ledgers import PROFILE, SAFE, supplier_ledger, table
from .model_queries import BASE, SELECTED, rounded_anomalies
from .model_queries import ORACLES as ORACLES_OF_MODELS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def users(spark, folder: str) -> DataFrame:
    first = F.to_timestamp(F.lit("1995-01-01 00:00:00"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.sha2(F.col("c_name").cast("binary"), 256).alias("api_key"),
        F.col("c_name").alias("organization"),
        F.lit(None).cast("string").alias("email"),
        first.alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_used"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def files(spark, folder: str) -> DataFrame:
    """One file per order; its content is the day and the whole amount, so some contents repeat."""
    day = text.iso_date(F.col("o_orderdate"))
    content = F.concat_ws(";", day, F.floor(F.col("o_totalprice") / 1000).cast("string"))
    odd = F.pmod("o_orderkey", F.lit(50))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(odd != 0, F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))).alias("filename"),
        F.when(odd != 1, text.content_hash(content.cast("binary"))).alias("file_hash"),
        F.when(odd != 2, F.pmod("o_orderkey", F.lit(30))).alias("row_count"),
        day.alias("date_range_start"),
        F.when(odd != 3, day).alias("date_range_end"),
        F.col("o_orderdate").alias("uploaded_at"),
    )


FILES = """files AS (
  SELECT o_orderkey AS file_id, o_custkey AS user_id,
    CASE WHEN o_orderkey % 50 <> 0 THEN 'order_' || o_orderkey END AS filename,
    CASE WHEN o_orderkey % 50 <> 1 THEN sha256(strftime(o_orderdate, '%Y-%m-%d') || ';'
      || CAST(floor(o_totalprice / 1000) AS BIGINT)) END AS file_hash,
    CASE WHEN o_orderkey % 50 <> 2 THEN o_orderkey % 30 END AS row_count,
    strftime(o_orderdate, '%Y-%m-%d') AS date_range_start,
    CASE WHEN o_orderkey % 50 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_range_end
  FROM orders)"""


def predictions(spark, folder: str) -> DataFrame:
    name = F.element_at(F.split("o_orderpriority", "-"), 1).cast("int")
    models = F.array(*[F.lit(m) for m in ("AR", "MA", "ARMA", "ARIMA", "SARIMA")])
    rows = table(spark, folder, "orders")
    forecast = F.struct(
        F.array(text.iso_date(F.add_months(F.trunc("o_orderdate", "month"), 1))).alias("dates"),
        F.array("o_totalprice").alias("values"),
        F.array(F.col("o_totalprice") + 1000).alias("confidence_upper"),
        F.array(F.col("o_totalprice") - 1000).alias("confidence_lower"),
    )
    return rows.select(
        F.col("o_orderkey").alias("pred_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("file_id"),
        F.get(models, name - 1).alias("model_name"),
        F.lit("(1, 0, 1)").alias("model_order"),
        F.lit("(0, 0, 0, 0)").alias("seasonal_order"),
        (F.pmod("o_orderkey", F.lit(24)) + 1).cast("int").alias("forecast_months"),
        F.col("o_totalprice").alias("model_aic"),
        F.to_json(forecast).alias("forecast_json"),
        F.col("o_orderdate").alias("created_at"),
    )


PREDICTIONS = """preds AS (
  SELECT o_orderkey AS pred_id, o_custkey AS user_id, o_totalprice, o_orderdate,
    ['AR', 'MA', 'ARMA', 'ARIMA', 'SARIMA'][CAST(o_orderpriority[1] AS INTEGER)] AS model_name,
    CAST(o_orderkey % 24 + 1 AS INTEGER) AS forecast_months, o_totalprice AS model_aic
  FROM orders)"""


def anomalies(spark, folder: str) -> DataFrame:
    """Line items whose quantity, in tens, counts as the number of deviations; from two on they are kept."""
    far = F.col("l_quantity") / 15
    rows = table(spark, folder, "lineitem").filter(far >= fixed.SIGMA_MEDIUM)
    predicted = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    residual = F.round(F.col("l_extendedprice") - predicted, 2)
    severity = anomaly.severity_of(far)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("anomaly_id"),
        F.col("l_orderkey").alias("pred_id"),
        text.iso_date(F.col("l_shipdate")).alias("anomaly_date"),
        F.col("l_extendedprice").alias("actual_value"),
        predicted.alias("predicted_value"),
        residual.alias("residual"),
        far.alias("std_deviations"),
        severity.alias("severity"),
        anomaly.describe(severity, anomaly.percent_off(residual, predicted), residual).alias("description"),
    )


ANOMALIES = """anoms AS (
  SELECT l_orderkey * 10 + l_linenumber AS anomaly_id, l_orderkey AS pred_id,
    strftime(l_shipdate, '%Y-%m-%d') AS anomaly_date, l_extendedprice AS actual_value, l_quantity / 15 AS std_deviations,
    CASE WHEN l_quantity / 15 >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM lineitem WHERE l_quantity / 15 >= 2)"""
COUNTS = f"""{FILES}, {PREDICTIONS}, {ANOMALIES}, fc AS (
  SELECT user_id, count(*) AS files_uploaded, sum(row_count) AS total_rows FROM files GROUP BY 1
), ac AS (
  SELECT user_id, count(*) AS anomalies, count(*) FILTER (WHERE severity = 'HIGH') AS high,
    count(*) FILTER (WHERE severity = 'MEDIUM') AS medium FROM anoms JOIN preds ON preds.pred_id = anoms.pred_id GROUP BY 1
), pc AS (SELECT user_id, count(*) AS predictions FROM preds GROUP BY 1
), counts AS (
  SELECT c_custkey AS user_id, c_name AS organization, c_acctbal > 0 AS is_active, coalesce(files_uploaded, 0) AS files_uploaded,
    CAST(coalesce(total_rows, 0) AS BIGINT) AS total_rows_processed, coalesce(predictions, 0) AS predictions_made,
    coalesce(anomalies, 0) AS anomalies_detected, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium
  FROM customer LEFT JOIN fc ON fc.user_id = c_custkey LEFT JOIN pc ON pc.user_id = c_custkey LEFT JOIN ac ON ac.user_id = c_custkey
)"""
USES = """uses AS (
  SELECT user_id, model_name, count(*) AS uses,
    row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, model_name) AS place
  FROM preds GROUP BY 1, 2)"""


@query("register_accounts", "SELECT c_custkey AS user_id, sha256(c_name) AS api_key, c_name AS organization, c_acctbal > 0 AS is_active FROM customer")
def register_accounts(spark, folder):
    return users(spark, folder).select("user_id", "api_key", "organization", "is_active")


@query(
    "account_counts",
    f"""WITH {COUNTS} SELECT user_id, organization, is_active, files_uploaded, predictions_made, anomalies_detected FROM counts""",
)
def account_counts(spark, folder):
    info = history.account_info(
        users(spark, folder), files(spark, folder), predictions(spark, folder), anomalies(spark, folder)
    )
    return info.drop("created_at", "last_used")


@query(
    "file_list",
    f"""WITH {FILES} SELECT user_id, file_id, coalesce(filename, '(unknown)') AS filename,
      file_hash[1:12] || '...' AS file_hash, coalesce(row_count, 0) AS row_count, date_range_start, date_range_end,
      'from ' || date_range_start || ' to ' || coalesce(date_range_end, 'None') AS date_range FROM files""",
)
def file_list(spark, folder):
    return history.list_files(files(spark, folder)).drop("uploaded_at")


@query(
    "prediction_list",
    f"""WITH {PREDICTIONS} SELECT user_id, pred_id, model_name AS model, '(1, 0, 1)' AS "order", forecast_months,
      model_aic AS aic FROM preds WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def prediction_list(spark, folder):
    active = users(spark, folder).filter("is_active")
    owned = history.owned(predictions(spark, folder), active)
    return history.list_predictions(owned).drop("created_at")


@query(
    "prediction_detail",
    f"""WITH {PREDICTIONS}, {ANOMALIES}, a AS (
      SELECT pred_id, count(*) AS k, min(anomaly_date) AS first_date, round(max(std_deviations), 6) AS far FROM anoms GROUP BY 1)
    SELECT preds.pred_id, user_id, model_name AS model, forecast_months, coalesce(k, 0) AS anomalies_count,
      first_date AS first_anomaly, far AS largest_deviation,
      strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS forecast_date,
      round(o_totalprice, 2) AS forecast_value, round(o_totalprice + 1000, 2) AS forecast_upper
    FROM preds LEFT JOIN a ON a.pred_id = preds.pred_id""",
)
def prediction_detail(spark, folder):
    rows = history.prediction_detail(predictions(spark, folder), anomalies(spark, folder))
    return rows.select(
        "pred_id",
        "user_id",
        "model",
        "forecast_months",
        "anomalies_count",
        F.get("anomalies", F.lit(0))["date"].alias("first_anomaly"),
        F.round(F.array_max(F.transform("anomalies", lambda a: a["std_deviations"])), 6).alias("largest_deviation"),
        F.get("forecast.dates", F.lit(0)).alias("forecast_date"),
        F.round(F.get("forecast.values", F.lit(0)), 2).alias("forecast_value"),
        F.round(F.get("forecast.confidence_upper", F.lit(0)), 2).alias("forecast_upper"),
    )


def _listing(severity: str | None) -> str:
    where = f"WHERE severity = '{severity}'" if severity else ""
    return f"""WITH {PREDICTIONS}, {ANOMALIES} SELECT user_id, anomaly_id, anoms.pred_id, anomaly_date AS date,
      actual_value AS actual, round(std_deviations, 6) AS std_deviations, severity
      FROM anoms JOIN preds ON preds.pred_id = anoms.pred_id {where}"""


def _listed(spark, folder, severity: str | None) -> DataFrame:
    rows = history.list_anomalies(anomalies(spark, folder), predictions(spark, folder), severity)
    far = F.round("std_deviations", 6).alias("std_deviations")
    return rows.select("user_id", "anomaly_id", "pred_id", "date", "actual", far, "severity")


@query("anomaly_list", _listing(None))
def anomaly_list(spark, folder):
    return _listed(spark, folder, None)


@query("anomaly_list_high", _listing("HIGH"))
def anomaly_list_high(spark, folder):
    return _listed(spark, folder, "HIGH")


@query(
    "model_usage",
    f"WITH {PREDICTIONS} SELECT user_id, model_name, count(*) AS uses FROM preds GROUP BY 1, 2",
)
def model_usage(spark, folder):
    return history.model_usage(predictions(spark, folder))


@query(
    "top_models",
    f"WITH {PREDICTIONS}, {USES} SELECT user_id, model_name, uses, CAST(place AS INTEGER) AS place FROM uses WHERE place <= 3",
)
def top_models(spark, folder):
    return history.top_models(predictions(spark, folder))


@query(
    "model_statistics",
    f"""WITH {PREDICTIONS} SELECT model_name, count(*) AS uses, round(avg(CAST(model_aic AS DECIMAL(18,2))), 3) AS mean_aic,
    round(avg(forecast_months), 6) AS mean_months FROM preds GROUP BY 1""",
)
def model_statistics(spark, folder):
    rows = history.model_statistics(predictions(spark, folder))
    return rows.select(
        "model_name", "uses", F.round("mean_aic", 3).alias("mean_aic"), F.round("mean_months", 6).alias("mean_months")
    )


@query(
    "usage_overview",
    f"""WITH {COUNTS}, {USES}, top AS (
      SELECT user_id, string_agg(model_name || '=' || uses, ',' ORDER BY place) AS models_used FROM uses WHERE place <= 3 GROUP BY 1)
    SELECT counts.*, anomalies_detected - high - medium AS low, coalesce(models_used, '') AS models_used
    FROM counts LEFT JOIN top ON top.user_id = counts.user_id""",
)
def usage_overview(spark, folder):
    rows = history.usage_overview(
        users(spark, folder), files(spark, folder), predictions(spark, folder), anomalies(spark, folder)
    )
    used = F.transform("models_used", lambda m: F.concat_ws("=", m["model"], m["uses"].cast("string")))
    return rows.withColumn("models_used", F.concat_ws(",", used)).drop("created_at", "last_used")


@query(
    "duplicate_files",
    f"""WITH {FILES} SELECT file_hash, count(*) AS copies, count(DISTINCT user_id) AS owners, min(file_id) AS first_file_id
    FROM files WHERE file_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_files(spark, folder):
    return history.duplicate_files(files(spark, folder))


@query("run_history")
def run_history(spark, folder):
    """The prediction rows a run over all suppliers adds to the history."""
    results = pipeline.forecast_ledger(supplier_ledger(spark, folder))
    return tables.run_tables(results, "run", 1)["predictions"].drop("created_at")


# --- Appends and lookups ----------------------------------------------------------------------------------------------


@query(
    "append_accounts",
    """SELECT c_custkey AS user_id, sha256(c_name) AS api_key, c_name AS organization, c_acctbal > 0 AS is_active
    FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""",
)
def append_accounts(spark, folder):
    """Two batches of accounts that overlap, each of them given twice."""
    place, accounts = shared_folder(spark, "accounts"), users(spark, folder)
    for batch, some in (("first", accounts.where("user_id % 3 <> 0")), ("second", accounts.where("user_id % 2 = 0"))):
        for _ in range(2):
            tables.append_users(some, place, batch)
    found = tables.committed_tables(spark, place)["users"]
    return found.select("user_id", "api_key", "organization", "is_active")


def _appended_run(spark, folder: str) -> dict[str, DataFrame]:
    """One run over all suppliers, appended twice."""
    place, results = shared_folder(spark, "run"), cut_lineage(pipeline.forecast_ledger(supplier_ledger(spark, folder)))
    for _ in range(2):
        tables.append_run(results, place, "run", 1)
    return tables.committed_tables(spark, place)


def _entity(found: dict[str, DataFrame]) -> DataFrame:
    return found["uploaded_files"].select("file_id", F.regexp_replace("filename", "^by_code_", "").alias("entity"))


@query(
    "run_files",
    f"""WITH {BASE}, {PROFILE} SELECT 'by_code_' || p.entity AS filename, l.row_count, p.n_months, strftime(first_month, '%Y-%m-%d') AS date_range_start,
    strftime(last_month, '%Y-%m-%d') AS date_range_end FROM prof p JOIN (SELECT entity, count(*) AS row_count FROM led GROUP BY 1) l ON l.entity = p.entity""",
)
def run_files(spark, folder):
    return _appended_run(spark, folder)["uploaded_files"].select("filename", "row_count", "n_months", "date_range_start", "date_range_end")


@query(
    "run_predictions",
    f"""WITH RECURSIVE {BASE}, {PROFILE}, {SELECTED}
    SELECT path.entity, model AS model_name, CASE model WHEN 'AR' THEN '(1, 0, 0)' WHEN 'MA' THEN '(0, 0, 1)' WHEN 'ARIMA' THEN '(1, 1, 1)' ELSE '(1, 0, 1)' END AS model_order,
      CASE model WHEN 'SARIMA' THEN '(1, 1, 1, 12)' ELSE '(0, 0, 0, 0)' END AS seasonal_order, CAST({SAFE} AS INTEGER) AS forecast_months,
      h, strftime(CAST(path.last_month + to_months(h) AS DATE), '%Y-%m-%d') AS date, round(path.y[-1], 1) AS value
    FROM path JOIN prof ON prof.entity = path.entity WHERE h BETWEEN 1 AND {SAFE}""",
)
def run_predictions(spark, folder):
    """The predictions of the run, their stored forecasts read back."""
    found = _appended_run(spark, folder)
    rows = found["predictions"].join(_entity(found), "file_id").withColumn("f", F.from_json("forecast_json", tables.FORECAST))
    points = F.posexplode(F.arrays_zip(F.col("f.dates").alias("date"), F.col("f.values").alias("value"))).alias("place", "p")
    each = rows.select("entity", "model_name", "model_order", "seasonal_order", "forecast_months", points)
    return each.select(*each.columns[:5], (F.col("place") + 1).alias("h"), "p.date", F.round("p.value", 1).alias("value"))


@query("run_anomalies", ORACLES_OF_MODELS["pipeline_anomalies"])
def run_anomalies(spark, folder):
    found = _appended_run(spark, folder)
    owners = found["predictions"].join(_entity(found), "file_id").select("pred_id", "entity")
    rows = found["anomalies"].join(owners, "pred_id").withColumn("anomaly_date", F.col("anomaly_date").cast("date"))
    return rounded_anomalies(rows)


@query(
    "prediction_by_key",
    f"""WITH {PREDICTIONS}, latest AS (SELECT o_custkey, max(o_orderkey) AS pred_id FROM orders GROUP BY 1),
    account AS (SELECT c_custkey FROM customer JOIN latest ON o_custkey = c_custkey ORDER BY c_custkey DESC LIMIT 1)
    SELECT p.user_id, p.pred_id, model_name AS model, forecast_months, o_totalprice AS aic FROM preds p JOIN latest l ON l.pred_id = p.pred_id
    JOIN account a ON a.c_custkey = p.user_id""",
)
def prediction_by_key(spark, folder):
    """From a key to its account to the account's latest prediction, out of bucketed tables: the last account that has one."""
    place = shared_folder(spark, "bucketed")
    tables.append_users(users(spark, folder), place, "all")
    rows = predictions(spark, folder).withColumn("run_id", F.lit("all"))
    journal.append(rows, f"{place}/predictions", "all", *tables.KEYS["predictions"])
    found = tables.committed_tables(spark, place)
    last = rows.groupBy("user_id").agg(F.max("pred_id").alias("pred_id")).join(users(spark, folder), "user_id").orderBy(F.desc("user_id")).select("api_key", "pred_id").first()
    one = tables.prediction_by_key(found, *last)
    return one.select("user_id", "pred_id", F.col("model_name").alias("model"), "forecast_months", F.col("model_aic").alias("aic"))


@query(
    "forecast_by_index",
    ORACLES_OF_MODELS["forecast_selected"] + " AND path.entity = (SELECT max(entity) FROM led)",
)
def forecast_by_index(spark, folder):
    """All forecasts in bucket files, one entity's read back by the index alone: the last one by name."""
    place, ledger = shared_folder(spark, "indexed"), supplier_ledger(spark, folder)
    sinks.write_indexed(pipeline.forecast_rows(pipeline.forecast_ledger(ledger)), place)
    last = ledger.agg(F.max("entity")).first()[0]
    rows = sinks.read_indexed(spark, place, last)
    return rows.select("entity", "model", "method", "h", "month", *[F.round(c, 1).alias(c) for c in ("value", "lower", "upper")])
