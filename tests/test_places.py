from pyspark.sql import functions as F

from tallycast.functions.names import unused
from tallycast.operators import places


def test_places_follow_the_order(spark):
    rows = [(i * 7919 % 1000, None if i % 17 == 0 else i % 5) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, part long").repartition(7)
    got = places.numbered(frame, F.col("part").asc_nulls_last(), F.col("id").desc()).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert [(r["id"], r["part"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(1, 1001))
    assert places.numbered(frame.limit(0), F.col("id")).columns == ["id", "part", "place"]
    assert places.numbered(frame.limit(0), F.col("id")).count() == 0


def test_names_are_unused():
    assert unused(["_at", "AT", "x"], "at", "at", "y") == ["__at", "___at", "y"]
