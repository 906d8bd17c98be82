import datetime as dt

import pytest
from conftest import ledger_of, month_rows
from pyspark.sql import functions as F

from tallycast.functions import calendars
from tallycast.operators import horizon, series


def months(df):
    return [(r.entity, r.month.isoformat(), r.y) for r in df.orderBy("entity", "month").collect()]


def test_gaps_are_zero_and_incomplete_month_is_dropped(spark):
    ledger = ledger_of(spark, [("a", "2024-01-05", 1), ("a", "2024-01-09", 2), ("a", "2024-03-02", 4), ("a", "2024-05-30", 8)])
    got = months(series.monthly_series(ledger))
    assert got == [
        ("a", "2024-01-01", 3.0),
        ("a", "2024-02-01", 0.0),
        ("a", "2024-03-01", 4.0),
        ("a", "2024-04-01", 0.0),
    ]
    assert len(months(series.monthly_series(ledger, "keep"))) == 5


@pytest.mark.parametrize(
    "policy, one, full_end", [("incomplete", 1, 2), ("always", 1, 1), ("unconditional", 0, 1), ("keep", 1, 2)]
)
def test_trailing_policies(spark, policy, one, full_end):
    ledger = ledger_of(spark, [("one", "2024-01-05", 1), ("end", "2024-01-31", 1), ("end", "2024-02-29", 1)])
    rows = series.monthly_series(ledger, policy).groupBy("entity").count().collect()
    counts = {r["entity"]: r["count"] for r in rows}
    assert counts.get("one", 0) == one
    assert counts["end"] == full_end


def test_comma_monthly_fixture(spark):
    ledger = ledger_of(spark, month_rows("f", range(14), "2023-01"))
    assert series.monthly_series(ledger).count() == 13


def test_daily_grid(spark):
    ledger = ledger_of(spark, [("a", "2024-01-30", 1), ("a", "2024-02-02", 2)])
    got = [(r.date.isoformat(), float(r.amount)) for r in series.daily_filled(ledger).orderBy("date").collect()]
    assert got == [("2024-01-30", 1.0), ("2024-01-31", 0.0), ("2024-02-01", 0.0), ("2024-02-02", 2.0)]


def test_partitioning_and_order_do_not_matter(spark):
    rows = [("a", f"2024-{m:02d}-15", 0.1 * m + d) for m in range(1, 13) for d in range(40)]
    one = months(series.monthly_series(ledger_of(spark, rows).coalesce(1)))
    many = months(series.monthly_series(ledger_of(spark, rows[::-1]).repartition(13)))
    assert one == many


@pytest.mark.parametrize(
    "values, asked, want, reason",
    [
        ([5] * 12, None, 4, "MODE AUTO"),
        ([5] * 2, None, 3, "MODE AUTO"),
        ([0] * 24, None, 3, "MODE AUTO - sparsity detected"),
        ([5] * 200, None, 24, "MODE AUTO"),
        ([5] * 12, "6", 6, "USER OVERRIDE (6)"),
        ([5] * 12, "2", 2, "USER OVERRIDE (2 <= safe 4)"),
        ([5] + [0] * 49 + [5] + [0] * 21, "36", 3, "USER REQUEST REDUCED (36 → 3)"),
        ([5] + [0] * 49 + [5] + [0] * 21, None, 3, "MODE AUTO - sparsity detected"),
        ([5] * 12, "many", 4, "INVALID USER REQUEST (many)"),
        ([5] * 12, "0", 4, "INVALID USER REQUEST (0)"),
        ([5] * 12, "13", 4, "USER REQUEST REDUCED (13 → 4)"),
    ],
)
def test_smart_duration(spark, values, asked, want, reason):
    monthly = series.monthly_series(ledger_of(spark, month_rows("a", values)), "keep")
    row = horizon.smart_duration(series.profile(monthly), F.lit(asked)).first()
    assert (row.months, row.reason) == (want, reason)


def test_requests(spark):
    monthly = series.monthly_series(ledger_of(spark, sum((month_rows(e, [5] * 12) for e in "abc"), [])), "keep")
    wishes = spark.createDataFrame([("a", "s"), ("b", "2"), ("z", "4")], "entity string, months string")
    got = {r.entity: (r.status, r.months) for r in horizon.with_requests(series.profile(monthly), wishes).collect()}
    assert got == {"a": ("skipped", 4), "b": ("ok", 2), "c": ("ok", 4)}


def test_business_days(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 15)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    flagged = calendars.flag_business_days(df, calendars.holiday_table(spark))
    good = sorted(r.date.day for r in flagged.filter("is_business_day").collect())
    assert good == [2, 3, 4, 5, 8, 9, 10, 12]
    only = calendars.business_days_only(df, calendars.holiday_table(spark))
    assert sorted(r.date.day for r in only.collect()) == good
    assert calendars.holidays_only(df, calendars.holiday_table(spark)).count() == 2


def test_future_months(spark):
    row = spark.range(1).select(calendars.future_months(F.lit("2024-11-01").cast("date"), F.lit(3)).alias("m")).first()
    assert [d.isoformat() for d in row.m] == ["2024-12-01", "2025-01-01", "2025-02-01"]
