"""Classical additive decomposition with period 12, and the seasonality flag.

Only windows over ``entity``: all of them share one hash partitioning, so the decomposition adds no
shuffle to the one that ordered the months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .series import by_entity, by_month

HALF = fixed.SEASON // 2


def centred_average(y: Column) -> Column:
    """Centred 2x12 moving average; null on the six months at each end."""
    ahead, behind = F.lead(y, HALF).over(by_month()), F.lag(y, HALF).over(by_month())
    middle = F.sum(y).over(by_month().rowsBetween(1 - HALF, HALF - 1))
    return (0.5 * behind + middle + 0.5 * ahead) / fixed.SEASON


def decompose(monthly: DataFrame) -> DataFrame:
    """Add t, season_place (0..11), trend, seasonal and residual to (entity, month, y).

    Series shorter than two years have no decomposition: the three columns are null.
    """
    placed = (
        monthly.withColumn("t", F.row_number().over(by_month()))
        .withColumn("n_months", F.count(F.lit(1)).over(by_entity()))
        .withColumn("season_place", F.pmod(F.col("t") - 1, F.lit(fixed.SEASON)).cast("int"))
    )
    long_enough = F.col("n_months") >= fixed.MIN_SEASONAL_MONTHS
    trended = placed.withColumn("trend", F.when(long_enough, centred_average(F.col("y"))))
    by_place = W.partitionBy("entity", "season_place")
    placed_mean = trended.withColumn("place_mean", F.avg(F.col("y") - F.col("trend")).over(by_place))
    # Each place counts once in the mean of the twelve, however many years it has.
    first_year = F.when(F.col("t") <= fixed.SEASON, F.col("place_mean"))
    centred = placed_mean.withColumn("seasonal", F.col("place_mean") - F.avg(first_year).over(by_entity()))
    return centred.withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal")).drop("place_mean")


def seasonality(monthly: DataFrame, share: float = fixed.SEASONAL_SHARE_SERVICE) -> DataFrame:
    """One row per entity: amplitude of the seasonal part, of the series, and the flag."""
    parts = decompose(monthly)
    spread = parts.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_months"),
        (F.max("seasonal") - F.min("seasonal")).alias("season_amplitude"),
        (F.max("y") - F.min("y")).alias("total_amplitude"),
    )
    return spread.withColumn("seasonal", is_seasonal(F.col("season_amplitude"), F.col("total_amplitude"), share))


def is_seasonal(season_amplitude: Column, total_amplitude: Column, share: float) -> Column:
    """The seasonal part moves more than a share of the whole; false when there is no decomposition."""
    return F.coalesce(season_amplitude > share * total_amplitude, F.lit(False))
