"""Forecasts with 95 % bands, for every kind of model, as built-in expressions on packed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels
from ..functions.calendars import future_months
from ..functions.packed import bind
from .models import working_series

def running_sum_of_squares(weights: Column) -> Column:
    """1, 1 + w1^2, 1 + w1^2 + w2^2, ... without the last weight."""

    def step(acc: Column, w: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + w * w))

    return bind(weights, lambda w: F.slice(F.aggregate(w, F.array(F.lit(1.0)), step), F.lit(1), F.size(w)))


def with_path(chosen: DataFrame, months: Column, values: str = "ys") -> DataFrame:
    """Add ``errors`` (one-step errors of the differenced series, zero at its first value, where nothing is
    known) and ``path``, an array of (value, lower, upper) for the next ``months``; null without a fit. ``path_error`` is the failure
    of a series whose path could not be worked out, null for all others."""
    fit = F.col("fit")
    inputs = [fit[k].cast("double") for k in ("phi", "theta", "seasonal_phi", "seasonal_theta", "d", "sd")]
    worked = F.when(fit.isNotNull(), working_series(F.col(values), fit["d"], fit["sd"]))
    run = kernels.css_path_udf(fixed.SEASON)(worked, F.col(values), *inputs, months.cast("int"))
    band = F.zip_with(
        F.col("_run.ahead"),
        F.col("_run.growth"),
        lambda v, growth: _band(v, F.lit(fixed.Z95) * F.sqrt(fit["sigma2"] * growth)),
    )
    ran = chosen.withColumn("_run", run)
    return ran.select(*chosen.columns, F.col("_run.errors").alias("errors"), band.alias("path"), F.col("_run.error").alias("path_error"))


def _band(value: Column, half: Column) -> Column:
    return F.struct(value.alias("value"), (value - half).alias("lower"), (value + half).alias("upper"))


def smooth_path(smooth: Column, n: Column, months: Column) -> Column:
    """Path of the Holt-Winters fit: level, trend and the seasonal value of the month's place."""
    s = fixed.SEASON
    ahead = F.sequence(F.lit(1), F.greatest(months.cast("int"), F.lit(1)))

    def weight(j: Column) -> Column:
        turn = F.when(F.pmod(j, F.lit(s)) == 0, smooth["gamma"]).otherwise(F.lit(0.0))
        return smooth["alpha"] * (F.lit(1.0) + smooth["beta"] * j) + turn

    def value(k: Column) -> Column:
        return smooth["level"] + smooth["trend"] * k + F.get(smooth["season"], F.pmod(n + k - 1, F.lit(s)).cast("int"))

    sigma2 = smooth["sse"] / smooth["n_used"]
    return F.zip_with(
        F.transform(ahead, value),
        running_sum_of_squares(F.transform(ahead, weight)),
        lambda v, r: _band(v, F.lit(fixed.Z95) * F.sqrt(sigma2 * r)),
    )


def naive_path(last: Column, months: Column) -> Column:
    """The last value, repeated, with bounds equal to it."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(months.cast("int"), F.lit(1))),
        lambda _: F.struct(last.alias("value"), last.alias("lower"), last.alias("upper")),
    )


def long_forecast(rows: DataFrame, *carried: str, last_month: str = "last_month", path: str = "path") -> DataFrame:
    """(entity, h, month, value, lower, upper) out of one row per entity with a path."""
    dates = future_months(F.col(last_month), F.size(path))
    points = F.posexplode(F.arrays_zip(dates.alias("month"), F.col(path).alias("point"))).alias("place", "p")
    return rows.select("entity", *carried, points).select(
        "entity",
        *carried,
        (F.col("place") + 1).alias("h"),
        F.col("p.month").alias("month"),
        F.col("p.point.value").alias("value"),
        F.col("p.point.lower").alias("lower"),
        F.col("p.point.upper").alias("upper"),
    )


def naive_forecast(profiled: DataFrame) -> DataFrame:
    """Constant forecast of profiled series over their ``months``."""
    return long_forecast(profiled.withColumn("path", naive_path(F.col("last_y"), F.col("months"))))


def overlay(monthly: DataFrame, forecasts: DataFrame) -> DataFrame:
    """History and forecast on one time axis; the history has no bounds."""
    none = F.lit(None).cast("double")
    past = monthly.select(
        "entity", F.lit("history").alias("kind"), "month", F.col("y").alias("value"), none.alias("lower"), none.alias("upper")
    )
    ahead = forecasts.select("entity", F.lit("forecast").alias("kind"), "month", "value", "lower", "upper")
    return past.unionByName(ahead)


def forecast_kpis(monthly: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Last history value, mean and range of the forecast, per entity (one pass over the overlay)."""
    rows = overlay(monthly, forecasts)
    ahead = F.when(F.col("kind") == "forecast", F.col("value"))
    return rows.groupBy("entity").agg(
        F.max_by(F.col("value"), F.when(F.col("kind") == "history", F.col("month"))).alias("last_value"),
        F.avg(ahead).alias("mean_forecast"),
        (F.max(ahead) - F.min(ahead)).alias("forecast_range"),
    )
