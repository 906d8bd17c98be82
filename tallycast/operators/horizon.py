"""How many months may be forecast, and which series are too thin for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def safe_months(active: Column) -> Column:
    """A third of the active months, within the limits."""
    third = F.floor(active / F.lit(fixed.ACTIVE_PER_MONTH)).cast("int")
    return F.greatest(F.lit(fixed.MIN_MONTHS), F.least(F.lit(fixed.MAX_MONTHS), third))


def smart_duration(profiled: DataFrame, requested: Column | None = None) -> DataFrame:
    """Add safe_months, months and reason to rows with n_months, active_months and density.

    ``requested`` is text or a number; null means that the data decides. A request is granted up to the
    safe horizon, or up to the upper limit when the history is at least as long; else it is cut.
    """
    asked = requested.cast("string") if requested is not None else F.lit(None).cast("string")
    wanted = asked.try_cast("int")
    rows = profiled.withColumn("safe_months", safe_months(F.col("active_months")))
    safe = F.col("safe_months")
    within_safe = wanted <= safe
    within_limits = (wanted <= fixed.MAX_MONTHS) & (wanted <= F.col("n_months"))
    sparse = F.when(F.col("density") < fixed.SPARSE_PERCENT, " - sparsity detected").otherwise("")
    months = F.when(wanted.isNotNull() & (wanted >= 1) & (within_safe | within_limits), wanted).otherwise(safe)
    reason = (
        F.when(asked.isNull(), F.concat(F.lit("MODE AUTO"), sparse))
        .when(wanted.isNull() | (wanted < 1), F.format_string("INVALID USER REQUEST (%s)", asked))
        .when(within_safe, F.format_string("USER OVERRIDE (%d <= safe %d)", wanted, safe))
        .when(within_limits, F.format_string("USER OVERRIDE (%d)", wanted))
        .otherwise(F.format_string("USER REQUEST REDUCED (%d → %d)", wanted, safe))
    )
    return rows.withColumns({"requested_months": asked, "months": months, "reason": reason})


def with_requests(profiled: DataFrame, requests: DataFrame) -> DataFrame:
    """Join a table (entity, months) of asked horizons: ``s`` skips the entity, no value lets the data
    decide. An entity asked for twice keeps its largest number."""
    wish = requests.groupBy("entity").agg(
        F.max(F.lower(F.trim(F.col("months").cast("string"))) == "s").alias("skip"),
        F.max_by(F.trim(F.col("months").cast("string")), F.trim(F.col("months").cast("string")).try_cast("int")).alias(
            "asked"
        ),
        F.max(F.trim(F.col("months").cast("string"))).alias("asked_text"),
    )
    joined = profiled.join(wish, "entity", "left")
    text = F.coalesce(F.col("asked"), F.col("asked_text"))
    asked = F.when(F.col("skip") | (text == ""), None).otherwise(text)
    decided = smart_duration(joined, asked)
    status = F.when(F.coalesce(F.col("skip"), F.lit(False)), "skipped").otherwise("ok")
    return decided.withColumn("status", status).drop("skip", "asked", "asked_text")


def too_thin(ledger_rows: Column, constant: Column) -> Column:
    """Fewer ledger rows than a model needs, or one single amount."""
    return (ledger_rows < fixed.MIN_LEDGER_ROWS) | constant
