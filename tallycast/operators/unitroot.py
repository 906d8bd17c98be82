"""Unit-root test per series: t-value, p-value, stationarity flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels
from .series import by_month

# Response surface of the unit-root t-value with a constant (MacKinnon 1994).
SURFACE = {
    "max": 2.74,
    "min": -18.83,
    "star": -1.61,
    "small": [2.1659, 1.4412, 0.038269],
    "large": [1.7339, 0.93202, -0.12745, -0.010368],
}
# Normal distribution function (Abramowitz and Stegun 26.2.17).
CDF_RATE = 0.2316419
CDF_WEIGHTS = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def polynomial(x: Column, weights: list[float]) -> Column:
    value = F.lit(weights[-1])
    for weight in reversed(weights[:-1]):
        value = F.lit(weight) + x * value
    return value


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal, to about seven decimals."""
    size = F.abs(z)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_RATE) * size)
    density = F.exp(-size * size / 2.0) / F.lit(2.5066282746310002)
    tail = density * k * polynomial(k, CDF_WEIGHTS)
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def p_value(tau: Column) -> Column:
    z = F.when(tau <= SURFACE["star"], polynomial(tau, SURFACE["small"])).otherwise(
        polynomial(tau, SURFACE["large"])
    )
    return F.when(tau > SURFACE["max"], 1.0).when(tau < SURFACE["min"], 0.0).otherwise(normal_cdf(z))


def with_unit_root(series: DataFrame, fixed_lag: int | None = None, values: Column | None = None) -> DataFrame:
    """Add tau, used_lag, n_used, unit_root_status, p_value and stationary to packed series.

    ``stationary`` is null when the test cannot be run (constant or too short a series, or null ``values``).
    A series that follows its own past exactly has no t-value; it is not taken for stationary.
    """
    tested = F.col("ys") if values is None else values
    rows = series.withColumn("_test", kernels.unit_root_udf(SURFACE, fixed_lag)(tested))
    rows = rows.select(
        *series.columns,
        F.col("_test.tau").alias("tau"),
        F.col("_test.used_lag").alias("used_lag"),
        F.col("_test.n_used").alias("n_used"),
        F.col("_test.status").alias("unit_root_status"),
        F.col("_test.p_value").alias("p_value"),
        F.when(F.col("_test.status").isin("exact fit", "collinear"), F.lit(False))
        .otherwise(F.col("_test.p_value") <= fixed.STATIONARY_P)
        .alias("stationary"),
    )
    return rows


def plain_unit_root(monthly: DataFrame) -> DataFrame:
    """The test without lagged differences, with built-in regression aggregates alone."""
    pairs = monthly.withColumn("before", F.lag("y").over(by_month())).filter("before is not null")
    pairs = pairs.withColumn("step", F.col("y") - F.col("before"))
    sums = pairs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_used"),
        F.regr_slope("step", "before").alias("slope"),
        F.regr_sxx("step", "before").alias("sxx"),
        F.regr_syy("step", "before").alias("syy"),
        F.regr_sxy("step", "before").alias("sxy"),
    )
    left = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    error = F.sqrt(left / (F.col("n_used") - 2) / F.col("sxx"))
    fitted = sums.filter((F.col("n_used") > 2) & (F.col("sxx") > 0) & (left > 0))
    rows = fitted.select("entity", "n_used", (F.col("slope") / error).alias("tau"))
    return rows.withColumn("p_value", p_value(F.col("tau"))).withColumn(
        "stationary", F.col("p_value") <= fixed.STATIONARY_P
    )
