"""Score table and choice of a model per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from . import models

AIC_FAMILY, MSE_FAMILY = "aic", "mse"


def service_candidates(flagged: DataFrame, method: models.Method = models.GRID) -> DataFrame:
    """Fit the candidates of the service rule on packed series with flags ``seasonal`` and ``stationary``:
    a seasonal model when the series is seasonal; the integrated model when it is not stationary, else
    the three stationary ones."""
    stationary = F.col("stationary")
    seasonal = F.col("seasonal") & stationary.isNotNull()
    specs = [models.SARIMA, models.ARIMA, models.AR, models.MA, models.ARMA]
    active = [seasonal, ~stationary, stationary, stationary, stationary]
    return models.fit_specs(flagged, specs, [F.coalesce(a, F.lit(False)) for a in active], method=method)


def classic_candidates(flagged: DataFrame, method: models.Method = models.GRID) -> DataFrame:
    """Fit the candidates of the classic rule: a seasonal series gets the seasonal model alone, with a plain
    difference when it is not stationary; else as in the service rule."""
    stationary = F.col("stationary")
    seasonal = F.col("seasonal") & stationary.isNotNull()
    specs = [models.SARIMA, models.SARIMA_DIFF, models.ARIMA, models.AR, models.MA, models.ARMA]
    active = [
        seasonal & stationary,
        seasonal & ~stationary,
        ~seasonal & ~stationary,
        ~seasonal & stationary,
        ~seasonal & stationary,
        ~seasonal & stationary,
    ]
    return models.fit_specs(flagged, specs, [F.coalesce(a, F.lit(False)) for a in active], method=method)


def ranked_fits(fits: Column) -> Column:
    """The scored fits, best first; equal scores keep the order of the candidates."""
    scored = F.filter(fits, lambda f: f["status"] == "ok")
    keyed = F.transform(scored, lambda f: F.struct(f["aic"].alias("score"), f["place"].alias("place"), f.alias("fit")))
    return F.transform(F.array_sort(keyed), lambda k: k["fit"])


def choose_best(candidates: DataFrame) -> DataFrame:
    """Add ``fit``: the least AIC."""
    return candidates.withColumn("fit", F.get(ranked_fits(F.col("fits")), F.lit(0)))


def keeps_margin(best: Column, second: Column) -> Column:
    """The seasonal model must win by more than two points and by more than a tenth of its score."""
    delta = second["aic"] - best["aic"]
    share = F.when(best["aic"] != 0, delta / F.abs(best["aic"])).otherwise(F.lit(float("inf")))
    return (delta > fixed.MARGIN_POINTS) & (share > fixed.MARGIN_SHARE)


def choose_with_margin(candidates: DataFrame) -> DataFrame:
    """Add ``fit``, ``runner_up`` and ``margin_rule`` (kept, replaced or not applicable)."""
    rows = candidates.withColumn("_ranked", ranked_fits(F.col("fits")))
    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    judged = (best["name"] == models.SARIMA.name) & second.isNotNull()
    replaced = judged & ~keeps_margin(best, second)
    return rows.select(
        *candidates.columns,
        F.when(replaced, second).otherwise(best).alias("fit"),
        F.when(replaced, best).otherwise(second).alias("runner_up"),
        F.when(replaced, "replaced").when(judged, "kept").otherwise("not applicable").alias("margin_rule"),
    )


def score_table(candidates: DataFrame) -> DataFrame:
    """Long table (entity, family, place, name, label, score, status) of all candidates, with the
    smoothing fit, by its own AIC or else its squared error, when the column ``smooth`` is there."""
    entry = F.struct(
        F.lit(AIC_FAMILY).alias("family"),
        F.col("f.place").alias("place"),
        F.col("f.name").alias("name"),
        F.col("f.label").alias("label"),
        F.col("f.aic").alias("score"),
        F.col("f.status").alias("status"),
    )
    long = candidates.select("entity", F.explode("fits").alias("f")).select("entity", entry.alias("c"))
    if "smooth" in candidates.columns:
        other = F.struct(
            F.when(F.col("smooth.aic").isNotNull(), AIC_FAMILY).otherwise(MSE_FAMILY).alias("family"),
            F.lit(100).alias("place"),
            F.lit("HOLT_WINTERS").alias("name"),
            F.lit("HOLT_WINTERS").alias("label"),
            F.coalesce("smooth.aic", "smooth.mse").alias("score"),
            F.when(F.col("smooth").isNull(), "short").otherwise("ok").alias("status"),
        )
        classical = F.transform(
            "fits",
            lambda f: F.struct(
                F.lit(AIC_FAMILY).alias("family"),
                f["place"].alias("place"),
                f["name"].alias("name"),
                f["label"].alias("label"),
                f["aic"].alias("score"),
                f["status"].alias("status"),
            ),
        )
        long = candidates.select("entity", F.explode(F.concat(classical, F.array(other))).alias("c"))
    return long.select("entity", "c.*")


def rank_scores(scores: DataFrame) -> DataFrame:
    """Add the rank within (entity, family), the next score, and its absolute and relative distance."""
    order = W.partitionBy("entity", "family").orderBy(F.col("score").asc_nulls_last(), "place")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("next_score", F.lead("score").over(order))
    delta = F.col("next_score") - F.col("score")
    share = F.when(F.col("score") != 0, delta / F.abs("score"))
    return ranked.withColumn("delta", delta).withColumn("relative_delta", share)


def extended_choice(scores: DataFrame) -> DataFrame:
    """One winner per entity: the least AIC of all candidates that have one, smoothing included; a squared error
    counts only where no candidate has an AIC. ``next_score`` is that of the runner-up of the same kind."""
    fitted = rank_scores(scores.filter(F.col("status") == "ok")).filter(F.col("rank") == 1)
    first = W.partitionBy("entity").orderBy(F.col("family") != AIC_FAMILY)
    return fitted.withColumn("_turn", F.row_number().over(first)).filter("_turn = 1").drop("_turn")


def model_report(chosen: DataFrame, *carried: str) -> DataFrame:
    """(entity, model, model_order, seasonal_order, aic) and the carried columns."""
    fit = F.col("fit")
    return chosen.filter(fit.isNotNull()).select(
        "entity",
        fit["name"].alias("model"),
        models.order_of(fit).alias("model_order"),
        models.season_order_of(fit).alias("seasonal_order"),
        fit["aic"].alias("aic"),
        *carried,
    )
