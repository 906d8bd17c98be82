"""The given tables seen as ledgers, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def supplier_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Dense: every line item, by supplier."""
    rows = table(spark, folder, "lineitem")
    return clean.typed_ledger(rows, F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_extendedprice"))


def customer_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse: every order, by customer."""
    rows = table(spark, folder, "orders")
    return clean.typed_ledger(rows, F.col("o_custkey"), F.col("o_orderdate"), F.col("o_totalprice"))


def segment_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Few entities: every order, by the market segment of its customer."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = orders.join(customers, "o_custkey")
    return clean.typed_ledger(joined, F.col("c_mktsegment"), F.col("o_orderdate"), F.col("o_totalprice"))


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Daily: every event, by type."""
    rows = table(spark, folder, "events")
    return clean.typed_ledger(rows, F.col("event_type"), F.col("ts"), F.col("value"))


SUPPLIER = """led AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_shipdate AS DATE) AS date,
         CAST(l_extendedprice AS DECIMAL(20,4)) AS amount
  FROM lineitem
)"""
CUSTOMER = """led AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS date,
         CAST(o_totalprice AS DECIMAL(20,4)) AS amount
  FROM orders
)"""
SEGMENT = """led AS (
  SELECT c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS date,
         CAST(o_totalprice AS DECIMAL(20,4)) AS amount
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""
EVENT = """led AS (
  SELECT event_type AS entity, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(20,4)) AS amount FROM events
)"""
GRID = """msum AS (
  SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS amount, max(date) AS last_date
  FROM led GROUP BY 1, 2
), ends AS (
  SELECT entity, min(month) AS m0, max(month) AS m1, max(last_date) AS last_date FROM msum GROUP BY 1
), grid AS (
  SELECT entity, m0, m1, last_date, CAST(unnest(generate_series(m0, m1, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends
), allmon AS (
  SELECT g.entity, g.month, m0, m1, g.last_date, CAST(coalesce(s.amount, 0) AS DOUBLE) AS y
  FROM grid g LEFT JOIN msum s ON s.entity = g.entity AND s.month = g.month
)"""
INCOMPLETE = "month = m1 AND m1 > m0 AND last_date < last_day(m1)"
MONTHLY = (
    GRID
    + f""", mon AS (
  SELECT entity, month, y FROM allmon WHERE NOT ({INCOMPLETE})
), ser AS (
  SELECT entity, month, y, row_number() OVER (PARTITION BY entity ORDER BY month) AS t,
         count(*) OVER (PARTITION BY entity) AS n
  FROM mon
)"""
)
PROFILE = """prof AS (
  SELECT entity, count(*) AS n_months, count(*) FILTER (WHERE y > 0) AS active_months,
         count(*) FILTER (WHERE y > 0) * 100.0 / count(*) AS density, min(y) AS min_y, max(y) AS max_y,
         count(DISTINCT y) AS distinct_y, min(month) AS first_month, max(month) AS last_month,
         arg_max(y, month) AS last_y
  FROM mon GROUP BY 1
)"""
SAFE = "greatest(3, least(24, CAST(floor(active_months / 3) AS INTEGER)))"
