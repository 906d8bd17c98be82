"""Past months that lie far from what the model expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.packed import bind, sample_deviation
from .places import numbered
from .series import by_entity


def severity_of(deviations: Column) -> Column:
    return (
        F.when(deviations >= fixed.SIGMA_HIGH, "HIGH").when(deviations >= fixed.SIGMA_MEDIUM, "MEDIUM").otherwise("LOW")
    )


def percent_off(residual: Column, predicted: Column) -> Column:
    """Size of the residual in percent of the expected value; 0 when nothing was expected."""
    return F.when(predicted == 0, F.lit(0.0)).otherwise(F.abs(residual) / F.abs(predicted) * 100)


def describe(severity: Column, percent: Column, residual: Column) -> Column:
    # Wording and signs of the description.
    sign = F.when(severity == "HIGH", "🔴").when(severity == "MEDIUM", "🟡").otherwise("🟢")
    side = F.when(residual > 0, "supérieure").otherwise("inférieure")
    return F.format_string("%s Dépense %.0f%% %s à la normale", sign, percent, side)


def one_step_residuals(include_burn_in: bool = False) -> Column:
    """Array of residuals along ``ys`` out of the ``errors`` of the differenced series.

    The months a model needs to start have no forecast and a null residual; with ``include_burn_in``
    they count as forecast by zero, so that their whole value is a residual.
    """
    n, m = F.size("ys"), F.size("errors")
    known = F.slice("errors", F.lit(2), F.greatest(m - 1, F.lit(0)))
    if include_burn_in:
        start = F.slice("ys", F.lit(1), n - m + 1)
    else:
        start = F.array_repeat(F.lit(None).cast("double"), n - m + 1)
    return F.concat(start, known)


def fitted_rows(chosen: DataFrame, include_burn_in: bool = False, *carried: str) -> DataFrame:
    """(entity, month, y, predicted, residual) of models with ``errors``, for the months they forecast."""
    parts = F.arrays_zip(
        F.col("months_axis").alias("month"), F.col("ys").alias("y"), one_step_residuals(include_burn_in).alias("e")
    )
    rows = chosen.select("entity", *carried, F.explode(parts).alias("p")).filter(F.col("p.e").isNotNull())
    month, y, e = F.col("p.month"), F.col("p.y"), F.col("p.e")
    return rows.select(
        "entity", *carried, month.alias("month"), y.alias("y"), (y - e).alias("predicted"), e.alias("residual")
    )


def residual_moments(rows: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the residuals per entity."""
    return rows.groupBy("entity").agg(
        F.count("residual").alias("n_residuals"),
        F.avg("residual").alias("mean_residual"),
        F.stddev_samp("residual").alias("std_residual"),
    )


def scan(rows: DataFrame, *carried: str) -> DataFrame:
    """The months at two standard deviations or more of (entity, month, y, predicted, residual).

    A series without spread in its residuals has no anomaly.
    """
    spread = F.stddev_samp("residual").over(by_entity())
    scored = rows.withColumn("_std", spread).filter(F.col("_std") > 0)
    scored = scored.withColumn("std_deviations", F.abs("residual") / F.col("_std"))
    flagged = scored.filter(F.col("std_deviations") >= fixed.SIGMA_MEDIUM)
    severity = severity_of(F.col("std_deviations"))
    return flagged.select(
        "entity",
        *carried,
        F.col("month").alias("anomaly_date"),
        F.col("y").alias("actual_value"),
        F.col("predicted").alias("predicted_value"),
        "residual",
        "std_deviations",
        severity.alias("severity"),
        describe(severity, percent_off(F.col("residual"), F.col("predicted")), F.col("residual")).alias("description"),
    )


def anomaly_list(include_burn_in: bool = False) -> Column:
    """The anomalies of a series as an array in its own row, HIGH first, then the largest deviation.

    Same rule as ``scan``; no row leaves its task. Empty when there is no model.
    """
    parts = F.arrays_zip(
        F.col("months_axis").alias("month"), F.col("ys").alias("y"), one_step_residuals(include_burn_in).alias("e")
    )
    known = F.filter(parts, lambda p: p["e"].isNotNull())

    def flagged(known: Column) -> Column:
        values = F.transform(known, lambda p: p["e"])
        return bind(sample_deviation(values), lambda std: picked(known, std))

    def picked(known: Column, std: Column) -> Column:
        far = F.filter(known, lambda p: (std > 0) & (F.abs(p["e"]) / std >= fixed.SIGMA_MEDIUM))
        return F.transform(far, lambda p: entry(p["month"], p["y"], p["e"], F.abs(p["e"]) / std))

    def entry(month: Column, y: Column, e: Column, deviations: Column) -> Column:
        severity = severity_of(deviations)
        return F.struct(
            F.when(severity == "HIGH", 0).otherwise(1).alias("rank"),
            (-deviations).alias("order"),
            F.date_format(month, "yyyy-MM-dd").alias("date"),
            y.alias("actual_value"),
            (y - e).alias("predicted_value"),
            e.alias("residual"),
            deviations.alias("std_deviations"),
            severity.alias("severity"),
            describe(severity, percent_off(e, y - e), e).alias("description"),
        )

    names = ("date", "actual_value", "predicted_value", "residual", "std_deviations", "severity", "description")
    ordered = F.transform(
        F.array_sort(bind(known, flagged)), lambda a: F.struct(*[a[name].alias(name) for name in names])
    )
    return F.coalesce(ordered, F.filter(F.array(_no_anomaly()), lambda a: F.lit(False)))


def _no_anomaly() -> Column:
    text, number = F.lit("").cast("string"), F.lit(0.0)
    kinds = {"date": text, "actual_value": number, "predicted_value": number, "residual": number}
    kinds |= {"std_deviations": number, "severity": text, "description": text}
    return F.struct(*[value.alias(name) for name, value in kinds.items()])


def placed_in_report(anomalies: DataFrame) -> DataFrame:
    """Add ``place``, 1, 2, 3, ... in the order of :func:`in_report_order` over all entities, so that the order is part of the rows.

    Ranges of the order are sorted apart and numbered from their sizes; no task sees all anomalies.
    """
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return numbered(anomalies, rank, F.desc("std_deviations"), F.col("entity"), F.col("anomaly_date"))


def in_report_order(anomalies: DataFrame) -> DataFrame:
    """HIGH first, then the largest deviation: for a listing of one entity or a report."""
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return anomalies.orderBy(rank, F.desc("std_deviations"), "entity", "anomaly_date")
