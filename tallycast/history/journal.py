"""Appends that happen once, and tables that a lookup reads a small part of.

An append stages its rows in a folder of their own and then writes a commit of one line; readers join the commits, so they see a whole
append or nothing. A repeated append, of a task, a job or a whole run, finds its commit and adds nothing, or writes its staged
rows anew. Rows whose key is already there are left out, so overlapping appends add each key once. One writer a table at a
time: two appends that overlap and don't see each other would both add a key.

Inside an append rows lie in buckets by the hash of a column. A lookup by that column reads one bucket; a join on it reads the buckets of
the rows it joins (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
BUCKET, BATCH = "bucket", "batch"


def bucket_of(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def append(rows: DataFrame, folder: str, batch: str, keys: list[str], by: str, buckets: int = BUCKETS) -> None:
    """Add the rows of ``batch`` whose ``keys`` aren't in the table yet, once; of rows with equal keys, one. Null keys are keys like others."""
    spark = rows.sparkSession
    if not commits(spark, folder).where(F.col(BATCH) == batch).isEmpty():
        return
    have = committed(spark, folder, rows.schema).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_{i}"))
    fresh = rows.dropDuplicates(keys).join(have, same, "left_anti").withColumn(BUCKET, bucket_of(F.col(by), buckets))
    # A bucket is a few files whatever the number of tasks, and one account with a third of all rows is split again.
    fresh.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/data/{BATCH}={batch}")
    spark.range(1).select(F.lit(batch).alias("name"), F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").json(f"{folder}/commits/{BATCH}={batch}")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(batch) of the appends that are whole."""
    return _there(spark, f"{folder}/commits", "name string, at timestamp", "json", BATCH).select(F.col("name").alias(BATCH)).distinct()


def committed(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """The table's rows with their ``bucket`` and ``batch``; none where nothing was ever appended."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # Written files may hold null in any column.
    whole = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields] + [T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.StringType())])
    rows = _there(spark, f"{folder}/data", whole, "parquet", BATCH, BUCKET)
    return rows.join(commits(spark, folder), BATCH, "left_semi").select(whole.names)


def _there(spark: SparkSession, path: str, schema: str | T.StructType, kind: str, *partitions: str) -> DataFrame:
    """A folder that may not be there yet, without rows then."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def looked_up(table: DataFrame, by: str, value: object, buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``by`` = ``value``, out of one bucket."""
    return table.where((F.col(BUCKET) == bucket_of(F.lit(value).cast(table.schema[by].dataType), buckets)) & (F.col(by) == value))


def of_these(table: DataFrame, wanted: DataFrame, by: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose ``by`` is that of a row of ``wanted``, out of these rows' buckets."""
    keys = wanted.select(by).distinct().withColumn(BUCKET, bucket_of(F.col(by), buckets))
    return table.join(keys, [BUCKET, by], "left_semi")
