"""Autocorrelation and partial autocorrelation of every series, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed


def correlogram(series: DataFrame, lags: int = 24) -> DataFrame:
    """(entity, lag, acf, pacf, band) for lags 0 .. ``lags`` that the series supports.

    The partial value is given below half the length of the series. ``band`` is the half width of the 95 %
    band of white noise.
    """
    n = F.size("ys")
    scored = series.withColumn("acf_all", packed.autocorrelation(F.col("ys"), lags)).filter("acf_all is not null")
    scored = scored.withColumn("pacf_all", packed.partial_autocorrelation(F.col("acf_all"), lags))
    long = scored.select(
        "entity",
        n.alias("n_months"),
        F.posexplode(
            F.zip_with(
                "acf_all",
                F.concat(F.array(F.lit(1.0)), "pacf_all"),
                lambda a, p: F.struct(a.alias("acf"), p.alias("pacf")),
            )
        ).alias("lag", "r"),
    )
    return long.filter(F.col("lag") < F.col("n_months")).select(
        "entity",
        F.col("lag"),
        F.col("r.acf").alias("acf"),
        F.when(F.col("lag") * 2 < F.col("n_months"), F.col("r.pacf")).alias("pacf"),
        (F.lit(1.959963984540054) / F.sqrt("n_months")).alias("band"),
    )
