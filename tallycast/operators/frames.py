"""Lags, differences, look-back frames, splits and scaling, as windows over the monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .series import by_entity, by_month


def differences(monthly: DataFrame) -> DataFrame:
    """First difference, seasonal difference, and the first difference of the seasonal one."""
    rows = monthly.withColumn("lag_1", F.lag("y", 1).over(by_month())).withColumn(
        "lag_12", F.lag("y", fixed.SEASON).over(by_month())
    )
    rows = rows.withColumn("diff_1", F.col("y") - F.col("lag_1")).withColumn("diff_12", F.col("y") - F.col("lag_12"))
    return rows.withColumn("diff_1_12", F.col("diff_12") - F.lag("diff_12", 1).over(by_month()))


def minmax_scaled(monthly: DataFrame) -> DataFrame:
    """Each series on 0..1; a constant series becomes 0."""
    low, high = F.min("y").over(by_entity()), F.max("y").over(by_entity())
    spread = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return monthly.withColumn("scaled", (F.col("y") - low) / spread)


def lookback_frames(monthly: DataFrame, look_back: int = fixed.LOOK_BACK, train_share: float = 0.8) -> DataFrame:
    """One row per full frame: the scaled values before a month, that month's value, and its side of the
    chronological split. Series shorter than two frames give none."""
    past = by_month().rowsBetween(-look_back, -1)
    framed = (
        minmax_scaled(monthly)
        .withColumn("n_months", F.count(F.lit(1)).over(by_entity()))
        .withColumn("t", F.row_number().over(by_month()))
        .withColumn("frame", F.collect_list("scaled").over(past))
    )
    full = framed.filter((F.col("n_months") >= 2 * look_back) & (F.col("t") > look_back))
    train_frames = F.floor((F.col("n_months") - look_back) * F.lit(train_share))
    return full.select(
        "entity",
        "month",
        (F.col("t") - look_back).alias("frame_no"),
        "frame",
        F.col("scaled").alias("target"),
        F.when(F.col("t") - look_back <= train_frames, "train").otherwise("validate").alias("part"),
    )


def hold_out(monthly: DataFrame, months: int = fixed.HOLD_OUT) -> DataFrame:
    """Mark the last months of each series as the test part."""
    rows = monthly.withColumn("t", F.row_number().over(by_month())).withColumn(
        "n_months", F.count(F.lit(1)).over(by_entity())
    )
    return rows.withColumn("part", F.when(F.col("t") > F.col("n_months") - months, "test").otherwise("train"))
