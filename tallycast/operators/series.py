"""Ledger rows to regular daily and monthly series.

The ledger is summed per (entity, day) or (entity, month) before anything else: the partial sums are
taken where the rows are read, so an entity that holds a third of the ledger sends no more than its
months per task. Everything behind works on one row per entity and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_entity() -> WindowSpec:
    return W.partitionBy("entity")


def by_month() -> WindowSpec:
    return by_entity().orderBy("month")


def daily_sum(ledger: DataFrame) -> DataFrame:
    """Sum per entity and observed day."""
    return ledger.groupBy("entity", "date").agg(F.sum("amount").alias("amount"))


def daily_filled(ledger: DataFrame) -> DataFrame:
    """Sum per entity and calendar day, zero on days without a row, from the first to the last day."""
    step = W.partitionBy("entity").orderBy("date")
    days = daily_sum(ledger).withColumn("next_day", F.lead("date").over(step))
    upto = F.coalesce(F.date_sub("next_day", 1), F.col("date"))
    filled = days.select(
        "entity", "amount", F.posexplode(F.sequence("date", upto, F.expr("interval 1 day"))).alias("gap", "day")
    )
    return filled.select(
        "entity",
        F.col("day").alias("date"),
        F.when(F.col("gap") == 0, F.col("amount")).otherwise(F.lit(0).cast("decimal(30,4)")).alias("amount"),
    )


def monthly_sum(ledger: DataFrame) -> DataFrame:
    """Sum per entity and observed month, with what the later rules need to know about the rows."""
    return ledger.groupBy("entity", F.trunc("date", "month").cast("date").alias("month")).agg(
        F.sum("amount").alias("amount"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Hash-partition by entity into a fixed number of tasks.

    The windows, the packing and the fits behind need rows together by entity anyway. A plain exchange would be merged
    into a few tasks when the months are few bytes, and the fits, which cost far more than their bytes, would
    queue in them; a partition count that is asked for is kept.

    That count is ``spark.sql.shuffle.partitions``.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")


def monthly_series(ledger: DataFrame, trailing: str = "incomplete", with_rows: bool = False) -> DataFrame:
    """(entity, month, y): one row for every calendar month, zero where nothing was paid.

    ``trailing`` decides on the last month: ``incomplete`` drops it when the ledger stops before the
    month's end, ``always`` drops it whenever another month exists, ``unconditional`` drops it even if it
    is the only one, ``keep`` never drops it.
    ``with_rows`` adds ledger_rows, ledger_constant and ledger_last_date, per entity over all its rows.
    """
    months = spread(monthly_sum(ledger)).withColumn("next_month", F.lead("month").over(by_month()))
    is_last = F.col("next_month").isNull()
    has_other = F.col("first_month") < F.col("month")
    if trailing == "incomplete":
        drop = is_last & has_other & (F.col("last_date") < F.last_day("last_date"))
    elif trailing == "always":
        drop = is_last & has_other
    elif trailing == "unconditional":
        drop = is_last
    elif trailing == "keep":
        drop = F.lit(False)
    else:
        raise ValueError(f"unknown trailing policy {trailing!r}")
    months = months.withColumn("first_month", F.min("month").over(by_entity()))
    extra = []
    if with_rows:
        months = (
            months.withColumn("ledger_rows", F.sum("n_rows").over(by_entity()))
            .withColumn("ledger_constant", F.min("min_amount").over(by_entity()) == F.max("max_amount").over(by_entity()))
            .withColumn("ledger_last_date", F.max("last_date").over(by_entity()))
        )
        extra = ["ledger_rows", "ledger_constant", "ledger_last_date"]
    upto = F.coalesce(F.add_months("next_month", -1), F.col("month"))
    filled = months.filter(~drop).select(
        "entity",
        "amount",
        *extra,
        F.posexplode(F.sequence("month", upto, F.expr("interval 1 month"))).alias("gap", "grid_month"),
    )
    return filled.select(
        "entity",
        F.col("grid_month").alias("month"),
        F.when(F.col("gap") == 0, F.col("amount").cast("double")).otherwise(F.lit(0.0)).alias("y"),
        *extra,
    )


def profile(monthly: DataFrame) -> DataFrame:
    """One row per entity: length, activity, range and ends of the series."""
    active = F.count_if(F.col("y") > 0)
    return monthly.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_months"),
        active.alias("active_months"),
        (active * F.lit(100.0) / F.count(F.lit(1))).alias("density"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
        F.count_distinct("y").alias("distinct_y"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.max_by("y", "month").alias("last_y"),
    )


def packed(monthly: DataFrame, *carried: str) -> DataFrame:
    """One row per entity with its months and values as arrays in calendar order.

    An entity has as many elements as it has months, whatever the size of its ledger. ``carried``
    columns are constant within an entity and are kept as they are.
    """
    in_order = F.array_sort(F.collect_list(F.struct("month", "y")))
    rows = monthly.groupBy("entity").agg(in_order.alias("points"), *[F.first(c).alias(c) for c in carried])
    return rows.select(
        "entity",
        F.col("points.month").alias("months_axis"),
        F.col("points.y").alias("ys"),
        *carried,
    )


def unpacked(series: DataFrame) -> DataFrame:
    """Back to one row per entity and month, with the position in the series from 1."""
    points = F.posexplode(F.arrays_zip("months_axis", "ys")).alias("place", "point")
    return series.select("entity", points).select(
        "entity",
        (F.col("place") + 1).alias("t"),
        F.col("point.months_axis").alias("month"),
        F.col("point.ys").alias("y"),
    )
