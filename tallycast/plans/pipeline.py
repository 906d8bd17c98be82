"""Ledger to forecasts, anomalies, audit and result documents, for all entities in one plan.

The ledger is shuffled twice: partial sums by (entity, month), then the few months by entity. Everything
after that, from the decomposition to the result document, stays in the task of the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.calendars import future_months
from ..functions.text import folder_value, iso_date, safe_key
from ..operators import anomaly, clean, decompose, forecast, horizon, models, select, series, unitroot

RULES = {
    "service": ("incomplete", fixed.SEASONAL_SHARE_SERVICE),
    "classic": ("always", fixed.SEASONAL_SHARE_CLASSIC),
}


def diagnosed_series(
    ledger: DataFrame, rule: str = "service", requests: DataFrame | None = None, months: int | None = None
) -> DataFrame:
    """One row per entity: packed series, profile, horizon, seasonality and stationarity.

    A series that is too thin, constant or skipped by request is not tested and gets no model.
    """
    trailing, share = RULES[rule]
    monthly = series.monthly_series(ledger, trailing, with_rows=True)
    active = F.count_if(F.col("y") > 0)
    rows = (
        decompose.decompose(monthly)
        .groupBy("entity")
        .agg(
            F.array_sort(F.collect_list(F.struct("month", "y"))).alias("points"),
            F.count(F.lit(1)).alias("n_months"),
            active.alias("active_months"),
            (active * F.lit(100.0) / F.count(F.lit(1))).alias("density"),
            (F.max("seasonal") - F.min("seasonal")).alias("season_amplitude"),
            (F.max("y") - F.min("y")).alias("total_amplitude"),
            F.max("ledger_rows").alias("ledger_rows"),
            F.max("ledger_constant").alias("ledger_constant"),
        )
    )
    if requests is not None:
        rows = horizon.with_requests(rows, requests)
    else:
        rows = horizon.smart_duration(rows, F.lit(months) if months is not None else None)
        rows = rows.withColumn("status", F.lit("ok"))
    thin = (
        horizon.too_thin(F.col("ledger_rows"), F.col("ledger_constant"))
        | (F.col("total_amplitude") == 0)
        | (F.col("status") != "ok")
    )
    unasked = F.col("requested_months").isNull()
    seasonal = decompose.is_seasonal(F.col("season_amplitude"), F.col("total_amplitude"), share)
    kept = [c for c in rows.columns if c not in ("entity", "points", "ledger_constant", "months")]
    flagged = rows.select(
        "entity",
        F.col("points.month").alias("months_axis"),
        F.col("points.y").alias("ys"),
        F.element_at("points", -1)["month"].alias("last_month"),
        F.element_at("points", -1)["y"].alias("last_y"),
        *kept,
        thin.alias("thin"),
        F.when(thin & unasked, fixed.NAIVE_MONTHS).otherwise(F.col("months")).cast("int").alias("months"),
        (~thin & seasonal).alias("seasonal"),
    )
    return unitroot.with_unit_root(flagged, values=F.when(~F.col("thin"), F.col("ys")))


def chosen_models(diagnosed: DataFrame, rule: str = "service", method: models.Method = models.GRID) -> DataFrame:
    """Add the chosen ``fit`` and, only where no model could be scored, the smoothing fit; ``fit_error`` is the failure of
    a series that no model could be fitted to."""
    if rule == "classic":
        chosen = select.choose_best(select.classic_candidates(diagnosed, method))
        none = F.lit(None).cast(chosen.schema["fit"].dataType)
        chosen = chosen.withColumns({"runner_up": none, "margin_rule": F.lit("not applicable")})
    else:
        chosen = select.choose_with_margin(select.service_candidates(diagnosed, method))
    needed = F.when(F.col("fit").isNull() & ~F.col("thin"), F.col("ys"))
    smoothed = models.fit_smoothing(chosen.withColumn("_needed", needed), values="_needed", method=method)
    failed = F.get(F.filter(F.transform("fits", lambda f: f["status"]), lambda s: s.startswith("error: ")), F.lit(0))
    error = F.when(F.col("fit").isNull(), F.coalesce(failed, "smooth_error"))
    return smoothed.withColumn("fit_error", error).drop("_needed", "fits", "smooth_error")


def forecast_ledger(
    ledger: DataFrame,
    requests: DataFrame | None = None,
    months: int | None = None,
    rule: str = "service",
    include_burn_in: bool = False,
    method: models.Method = models.GRID,
) -> DataFrame:
    """One row per entity with everything that was found out about it. ``method`` is how models are fitted.

    An entity whose test or path fails, or all of whose fits do, has the status ``error: ...`` and neither model nor forecast; it stops no
    other. Where the smoothing fit steps in for models that failed, the failure is among the explanations.

    ``requests`` is an optional table (entity, months) of asked horizons, ``months`` one horizon for all.
    Columns: status, method (model, smoothing, naive), model, model_order, seasonal_order, aic, months, reason,
    path, errors, anomalies, explanations, and the diagnosis.
    """
    chosen = chosen_models(diagnosed_series(ledger, rule, requests, months), rule, method)
    chosen = forecast.with_path(chosen, F.col("months"))
    tested = F.when(F.col("unit_root_status").startswith("error: "), F.col("unit_root_status"))
    unfit = F.when(F.col("smooth").isNull(), F.col("fit_error"))
    failed = F.coalesce(tested, unfit, F.col("path_error"))
    chosen = chosen.withColumn("status", F.when((F.col("status") == "ok") & failed.isNotNull(), failed).otherwise(F.col("status")))
    fit, smooth = F.col("fit"), F.col("smooth")
    way = (
        F.when(F.col("status") != "ok", None)
        .when(fit.isNotNull(), "model")
        .when(smooth.isNotNull(), "smoothing")
        .otherwise("naive")
    )
    rows = chosen.drop("path_error").withColumn("method", way)
    by_method = {
        "model": (F.col("path"), fit["name"]),
        "smoothing": (forecast.smooth_path(smooth, F.col("n_months"), F.col("months")), F.lit("HOLT_WINTERS")),
        "naive": (forecast.naive_path(F.col("last_y"), F.col("months")), F.lit("NAIVE_CONSTANT")),
    }
    path, model = F.when(F.lit(False), F.col("path")), F.when(F.lit(False), F.lit(""))
    for name, (its_path, its_model) in by_method.items():
        path = path.when(F.col("method") == name, its_path)
        model = model.when(F.col("method") == name, its_model)
    rows = rows.withColumns(
        {
            "path": path,
            "model": model,
            "model_order": F.coalesce(models.order_of(fit), F.lit("()")),
            "seasonal_order": F.coalesce(models.season_order_of(fit), F.lit("()")),
            "aic": F.coalesce(fit["aic"], smooth["aic"], F.lit(0.0)),
            "anomalies": anomaly.anomaly_list(include_burn_in),
        }
    )
    return rows.withColumn("explanations", explanations()).drop("fit_error")


def explanations() -> Column:
    """Why this model and this horizon, as an ordered list of sentences."""
    fit, second = F.col("fit"), F.col("runner_up")
    no_test = F.concat(F.lit("Stationarity could not be tested: "), F.col("unit_root_status"))
    said = F.array(
        F.format_string("%d months, %d of them active (%.1f%%)", "n_months", "active_months", "density"),
        F.when(F.col("density") < fixed.SPARSE_PERCENT, "Very sparse data: forecasts are not reliable"),
        F.when(
            F.col("p_value").isNotNull(),
            F.format_string(
                "Unit-root p-value %.4f: %s",
                F.col("p_value"),
                F.when(F.col("p_value") <= fixed.STATIONARY_P, "stationary").otherwise("not stationary"),
            ),
        ).otherwise(no_test),
        F.when(F.col("n_months") < fixed.MIN_SEASONAL_MONTHS, "Too short for a seasonal pattern").otherwise(
            F.concat(F.lit("Seasonal pattern: "), F.when(F.col("seasonal"), "yes").otherwise("no"))
        ),
        F.when(second.isNotNull(), F.format_string("Runner-up %s with AIC %.1f", second["label"], second["aic"])),
        F.when(F.col("margin_rule") == "replaced", "The seasonal model did not win by the needed margin"),
        F.when(fit.isNotNull(), F.format_string("Chosen model %s with AIC %.1f", fit["label"], fit["aic"])),
        F.concat(F.lit("No model could be fitted: "), F.col("fit_error")),
        F.when(F.col("method") == "smoothing", "No model could be scored: exponential smoothing is used"),
        F.when(F.col("method") == "naive", "Series too short, constant or without a model: the last value is repeated"),
        F.format_string("Horizon %d months: %s", "months", "reason"),
        F.when(F.col("method") == "model", F.format_string("%d anomalies in the past", F.size("anomalies"))),
    )
    return F.filter(said, lambda line: line.isNotNull())


def forecast_rows(results: DataFrame) -> DataFrame:
    """(entity, model, method, h, month, value, lower, upper)"""
    return forecast.long_forecast(results, "model", "method")


def anomaly_rows(results: DataFrame) -> DataFrame:
    return results.select("entity", F.explode("anomalies").alias("a")).select("entity", "a.*")


def run_summary(results: DataFrame, out_path: str = "") -> DataFrame:
    """The audit table: what became of each entity and where its forecast lies; empty where none was made."""
    made = (F.col("status") == "ok") & (F.size("path") > 0)
    inner = F.concat(F.lit("/entity="), folder_value(F.col("entity")))
    place = F.when(made, F.concat(F.lit(out_path), safe_key(F.col("entity")), inner)).otherwise("")
    return results.select("entity", "status", "method", place.alias("out_path"))


def result_document() -> Column:
    """The nested result of one entity."""
    dates = F.transform(future_months(F.col("last_month"), F.size("path")), lambda d: iso_date(d))
    part = lambda name: F.transform("path", lambda p: p[name])
    return F.struct(
        F.when(F.col("status") == "ok", "success").otherwise(F.col("status")).alias("status"),
        F.struct(
            F.col("model").alias("name"),
            F.col("model_order").alias("order"),
            F.col("seasonal_order").alias("seasonal_order"),
            F.col("aic").alias("aic"),
        ).alias("model_info"),
        F.col("explanations"),
        F.struct(
            F.transform("months_axis", lambda d: iso_date(d)).alias("dates"), F.col("ys").alias("values")
        ).alias("history"),
        F.struct(
            dates.alias("dates"),
            part("value").alias("values"),
            part("upper").alias("confidence_upper"),
            part("lower").alias("confidence_lower"),
        ).alias("forecast"),
        F.col("anomalies"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.struct(
            F.col("requested_months"), F.col("months").alias("validated_months"), F.col("reason")
        ).alias("duration_info"),
    )


def result_json(results: DataFrame) -> DataFrame:
    """(entity, document) with the document as JSON text."""
    return results.select("entity", F.to_json(result_document()).alias("document"))


def by_code(ledger: DataFrame, codes: DataFrame, months: int | None = None, rule: str = "service") -> DataFrame:
    """Forecasts of the asked codes (entity, place). A code that the ledger does not hold is ``missing`` and has the first ten codes that it
    does hold as ``known_codes``; one whose forecast failed keeps its ``error: ...``."""
    asked = ledger.join(codes.select("entity"), "entity", "left_semi")
    results = forecast_ledger(asked, months=months, rule=rule).withColumnRenamed("status", "own_status")
    found = clean.select_codes(codes, results)
    found = found.withColumn("status", F.coalesce("own_status", "status")).drop("own_status")
    known = clean.known_codes(ledger).agg(F.array_sort(F.collect_list("entity")).alias("known_codes"))  # one row
    named = F.when(F.col("status") == "missing", F.col("known_codes"))
    return found.crossJoin(known).withColumn("known_codes", named)


def whole_ledger(ledger: DataFrame, months: int | None = None, rule: str = "service") -> DataFrame:
    """All entities pooled into one series."""
    return forecast_ledger(clean.pooled(ledger), months=months, rule=rule)


def final_forecast(ledger: DataFrame, months: int = fixed.FINAL_MONTHS) -> DataFrame:
    """The fixed seasonal model on every entity, after dropping the running month."""
    monthly = series.monthly_series(ledger, "unconditional")
    rows = series.packed(monthly).withColumn("last_month", F.element_at("months_axis", -1))
    return forecast.with_path(models.fit_one(rows, models.SARIMA_FINAL), F.lit(months))
