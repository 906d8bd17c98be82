"""Raw text ledger to typed rows, with the rejected rows and the reason kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.roles import Roles


def source_day_first(raw: DataFrame, date: str, prefer_day_first: bool, source: str | None = None) -> DataFrame:
    """The order of day and month, decided once per source from all its cells.

    A source keeps the preferred order unless some cell fits only the other one. The result has one
    row per source (one row in all without ``source``).
    """
    keys = [F.col(source).alias("source_key")] if source else []
    parts = raw.select(*keys, text.date_parts(F.col(date)).alias("parts"))
    cells = parts.groupBy(*(["source_key"] if source else [])).agg(
        F.max(text.only_day_first(F.col("parts"))).alias("has_dmy"),
        F.max(text.only_month_first(F.col("parts"))).alias("has_mdy"),
    )
    if prefer_day_first:
        decided = F.coalesce(F.col("has_dmy"), F.lit(False)) | ~F.coalesce(F.col("has_mdy"), F.lit(False))
    else:
        decided = F.coalesce(F.col("has_dmy"), F.lit(False)) & ~F.coalesce(F.col("has_mdy"), F.lit(False))
    return cells.select(*[c for c in cells.columns if c == "source_key"], decided.alias("day_first"))


def tag_rows(
    raw: DataFrame,
    roles: Roles,
    date_order: str = "day_first",
    entity: Column | None = None,
    source: str | None = None,
    surplus: Column | None = None,
) -> DataFrame:
    """(entity, raw_date, raw_amount, date, amount, reason); ``reason`` is null for a good row.

    ``date_order`` is ``day_first`` or ``month_first`` (per cell, ISO always wins), or
    ``auto_day_first`` / ``auto_month_first`` (decided once per source, see ``source_day_first``). ``surplus`` is the raw
    line where a line has too many cells to know which is which; it is rejected, with the line as its amount.
    """
    key = entity if entity is not None else F.trim(F.col(roles.entity).cast("string")) if roles.entity else F.lit("ALL")
    kept = [F.col(source).alias("source_key")] if source else []
    line = surplus if surplus is not None else F.lit(None).cast("string")
    rows = raw.select(
        *kept,
        key.alias("entity"),
        F.col(roles.date).alias("raw_date"),
        F.coalesce(line, F.col(roles.amount).cast("string")).alias("raw_amount"),
        line.isNotNull().alias("too_long"),
    )
    day_first: Column | bool
    if date_order.startswith("auto_"):
        order = source_day_first(raw, roles.date, date_order == "auto_day_first", source)
        rows = rows.join(order, "source_key") if source else rows.crossJoin(F.broadcast(order))  # one row
        day_first = F.col("day_first")
    else:
        day_first = date_order == "day_first"
    # The parts are a column of their own: named many times, split once. The one-element explode keeps the
    # later filter on the reason behind the parsing; pushed below it, the filter would parse every cell
    # again for each time a part is named.
    split = rows.withColumn("parts", text.date_parts(F.col("raw_date")))
    parsed = F.struct(
        text.date_from_parts(F.col("parts"), day_first).alias("date"),
        text.parse_amount(F.col("raw_amount")).alias("amount"),
    )
    tagged = split.select("entity", "raw_date", "raw_amount", "too_long", F.explode(F.array(parsed)).alias("p")).select(
        "entity", "raw_date", "raw_amount", "p.date", "p.amount", "too_long"
    )
    reason = (
        F.when(F.col("too_long"), "surplus cells")
        .when(F.col("entity").isNull(), "no entity")
        .when(F.col("date").isNull(), "bad date")
        .when(F.col("amount").isNull(), "bad amount")
    )
    return tagged.withColumn("reason", reason).drop("too_long")


def good_rows(tagged: DataFrame) -> DataFrame:
    """The clean ledger (entity, date, amount)."""
    return tagged.filter(F.col("reason").isNull()).select("entity", "date", "amount")


def rejected_rows(tagged: DataFrame) -> DataFrame:
    """What was dropped and why."""
    return tagged.filter(F.col("reason").isNotNull()).select("entity", "raw_date", "raw_amount", "reason")


def typed_ledger(df: DataFrame, entity: Column, date: Column, amount: Column) -> DataFrame:
    """A ledger out of columns that are typed already: the good rows of ``tag_typed``. The null tests are on the plain
    columns, so that they reach the scan."""
    present = entity.isNotNull() & date.isNotNull() & amount.isNotNull()
    return good_rows(tag_typed(df.filter(present), entity, date, amount))


def tag_typed(df: DataFrame, entity: Column, date: Column, amount: Column) -> DataFrame:
    """Typed columns in the form of ``tag_rows``: a row without an entity, a date or an amount that fits keeps its reason.

    Amounts are rounded to four decimals, as typed sources are computed ones; NaN, infinite and too large ones are bad.
    """
    tagged = df.select(
        entity.cast("string").alias("entity"),
        date.cast("string").alias("raw_date"),
        amount.cast("string").alias("raw_amount"),
        date.cast("date").alias("date"),
        amount.try_cast(text.MONEY).alias("amount"),
    )
    reason = (
        F.when(F.col("entity").isNull(), "no entity")
        .when(F.col("date").isNull(), "bad date")
        .when(F.col("amount").isNull(), "bad amount")
    )
    return tagged.withColumn("reason", reason)


def pooled(ledger: DataFrame) -> DataFrame:
    """The whole ledger as one series."""
    return ledger.withColumn("entity", F.lit("ALL"))


def one_code(ledger: DataFrame, code: str) -> DataFrame:
    """The rows of one entity. The filter runs where the rows are read; a source whose key is a plain text column, or that is
    partitioned by it, is pruned by filtering that column before."""
    return ledger.filter(F.trim(F.col("entity")) == code)


def code_list(spark, codes: str) -> DataFrame:
    """A comma-separated list as a table of distinct codes with their place in the list."""
    one = spark.range(1).select(F.posexplode(F.split(F.lit(codes), ",")).alias("place", "code"))
    return (
        one.select("place", F.trim("code").alias("entity"))
        .filter(F.col("entity") != "")
        .groupBy("entity")
        .agg(F.min("place").alias("place"))
    )


def select_codes(codes: DataFrame, keyed: DataFrame, status: str = "status") -> DataFrame:
    """Left join of the asked codes to one row per entity; a code without a row is ``missing``.

    The list is typed by a person, so it stays small and the planner broadcasts it by its size.
    """
    found = keyed.withColumn("_found", F.lit(True))
    joined = codes.join(found, "entity", "left")
    return joined.withColumn(status, F.when(F.col("_found"), "ok").otherwise("missing")).drop("_found")


def known_codes(ledger: DataFrame, limit: int = 10) -> DataFrame:
    """The first codes in order, for the report on a code that is not there."""
    return ledger.select("entity").distinct().orderBy("entity").limit(limit)


def first_entities(ledger: DataFrame, limit: int) -> DataFrame:
    """The rows of the first ``limit`` entities in order of name (top-k on keys, then a semi join)."""
    keys = ledger.select("entity").distinct().orderBy("entity").limit(limit)
    return ledger.join(keys, "entity", "left_semi")
