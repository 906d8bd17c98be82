"""Places in a global order, without a window that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.functions.names import unused
from tallycast.session import cut_lineage

#: monotonically_increasing_id keeps a row's place in its partition in so many bits.
PLACE_BITS = 33


def numbered(frame: DataFrame, *order: Column, name: str = "place", cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``frame`` with a column ``name``: 1, 2, 3, ... in the given order.

    Rows are dealt by ranges of the order and sorted in each range; a row's place is its place in its range and the sizes of the
    ranges before. Only those sizes, one for each range, meet in one task. ``cut`` writes the sorted rows once, so both uses see the same
    ranges. Rows that are equal in the order stand in any order, and all of them are in one range: where very many can be equal,
    end the order with a column that tells them apart.
    """
    part, at, rows, start = unused([*frame.columns, name], "part", "at", "rows", "start")
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    dealt = cut(dealt)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part).agg(F.count("*").alias(rows))
    starts = sizes.select(part, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start))
    # One row for each range.
    placed = dealt.join(F.broadcast(starts), part)
    return placed.select(*[F.col(f"`{c}`") for c in frame.columns], (F.col(start) + F.col(at) + 1).alias(name))
