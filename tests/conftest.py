import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallycast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def ledger_of(spark, rows):
    """Ledger out of (entity, ISO date, amount)."""
    from pyspark.sql import functions as F

    rows = [(entity, date, float(amount)) for entity, date, amount in rows]
    df = spark.createDataFrame(rows, "entity string, date string, amount double")
    return df.select("entity", F.col("date").cast("date").alias("date"), F.col("amount").cast("decimal(20,4)").alias("amount"))


def month_rows(entity, values, start="2020-01", day=None):
    """One ledger row per value, at the first day of consecutive months (or another day)."""
    year, month = map(int, start.split("-"))
    rows = []
    for value in values:
        rows.append((entity, f"{year:04d}-{month:02d}-{day or 1:02d}", float(value)))
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return rows
