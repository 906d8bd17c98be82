from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallycast.llm import sieve

ROWS = [(i % 50 if i % 7 else None, f"t{i % 3}", i) for i in range(400)] + [(3, "t0", 3), (3, "t0", 3)]
KEYS = [(None, "t1"), (3, "t0"), (8, None), (49, "t2"), (3, "t0")]


@pytest.mark.parametrize("words", [1, 64, 1 << 20])
def test_no_row_is_lost_and_none_with_a_key_stays(spark, words):
    frame = spark.createDataFrame(ROWS, "a long, b string, word int")
    keys = spark.createDataFrame(KEYS, "x long, y string")
    stay, may = sieve.parted(frame, [F.col("a"), F.col("b")], keys, sieve.Sieve(words))
    stay, may = [tuple(r) for r in stay.collect()], [tuple(r) for r in may.collect()]
    assert Counter(stay + may) == Counter(ROWS)
    wanted = set(KEYS)
    assert not [r for r in stay if r[:2] in wanted]
    if words > 64:  # a bitmap with room
        assert Counter(may) == Counter(r for r in ROWS if r[:2] in wanted)


def test_no_keys_and_no_rows(spark):
    frame = spark.createDataFrame(ROWS, "a long, b string, word int")
    stay, may = sieve.parted(frame, [F.col("a")], frame.select("a").limit(0))
    assert (stay.count(), may.count()) == (len(ROWS), 0)
    stay, may = sieve.parted(frame.limit(0), [F.col("a")], frame.select("a"))
    assert (stay.count(), may.count(), stay.columns) == (0, 0, frame.columns)


def test_the_bitmap_is_bounded(spark):
    assert sieve.bitmap(spark.range(100_000), sieve.Sieve(32)).count() == 32
