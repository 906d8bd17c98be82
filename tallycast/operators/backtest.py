"""Hold out the last year, forecast it, measure the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import forecast, models

# Fixed value: smallest denominator of the relative error (machine epsilon of a double).
EPSILON = 2.220446049250313e-16


def relative_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(EPSILON))


def mape(rows: DataFrame) -> DataFrame:
    """Mean absolute relative error per entity of (entity, y, value)."""
    return rows.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_tested"), F.avg(relative_error(F.col("y"), F.col("value"))).alias("mape")
    )


def in_sample_mse(rows: DataFrame, *carried: str) -> DataFrame:
    """Mean squared error of (entity, residual) per entity and ``carried`` columns."""
    return rows.groupBy("entity", *carried).agg(F.avg(F.col("residual") * F.col("residual")).alias("mse"))


def tested_rows(series: DataFrame, spec: models.Spec = models.SARIMA_FINAL, months: int = fixed.HOLD_OUT) -> DataFrame:
    """(entity, h, month, y, value, lower, upper): the held-out months next to their forecast.

    Train part, fit, forecast and comparison happen in the row of the entity.
    """
    kept = F.size("ys") - months
    enough = series.filter(kept >= spec.least_months)
    train = enough.withColumn("train", F.slice("ys", F.lit(1), kept))
    fitted = models.fit_one(train, spec, values="train")
    paths = forecast.with_path(fitted, F.lit(months), values="train")
    held = F.slice("ys", kept + 1, F.lit(months))
    held_months = F.slice("months_axis", kept + 1, F.lit(months))
    points = F.posexplode(F.arrays_zip(held_months.alias("month"), held.alias("y"), F.col("path").alias("f")))
    rows = paths.select("entity", points.alias("place", "p"))
    return rows.select(
        "entity",
        (F.col("place") + 1).alias("h"),
        F.col("p.month").alias("month"),
        F.col("p.y").alias("y"),
        F.col("p.f.value").alias("value"),
        F.col("p.f.lower").alias("lower"),
        F.col("p.f.upper").alias("upper"),
    )
