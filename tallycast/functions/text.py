"""Text to values and values to text, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact money: sums do not depend on the order or the partitioning of the rows.
MONEY = "decimal(20,4)"
# Wide enough to see whether an amount has more places than money keeps.
EXACT = "decimal(38,12)"


def parse_amount(c: Column) -> Column:
    """Drop blanks and no-break blanks, read a comma as the decimal point; null when not a number, or when money can't
    hold it exactly (16 digits before the point, four behind it)."""
    cell = F.translate(c.cast("string"), ",\u00a0 ", ".")
    exact, kept = cell.try_cast(EXACT), cell.try_cast(MONEY)
    return F.when(kept == exact, kept)


def date_parts(c: Column) -> Column:
    """The numbers of a date cell as text, without the time of day: ``31/01/2024 10:00`` is 31, 01, 2024."""
    day = F.substring_index(F.substring_index(F.trim(c.cast("string")), " ", 1), "T", 1)
    return F.split(F.translate(day, "/.", "--"), "-")


def _joined(year: Column, month: Column, day: Column) -> Column:
    """A date out of three texts, the year with four digits.

    The cast gives null at once where it fails, while a failing format pattern raises and catches an exception for
    every cell.
    """
    return F.when(F.length(year) == 4, F.concat_ws("-", year, month, day).try_cast("date"))


def _iso(parts: Column) -> Column:
    """``2024-01-31``, ``2024-01`` (its first day) or ``20240131``."""
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    compact = F.length(one) == 8
    return (
        F.when(F.size(parts) == 3, _joined(one, two, three))
        .when(F.size(parts) == 2, _joined(one, two, F.lit("01")))
        .when(compact, _joined(F.substring(one, 1, 4), F.substring(one, 5, 2), F.substring(one, 7, 2)))
    )


def _dmy(parts: Column) -> Column:
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(F.size(parts) == 3, _joined(three, two, one))


def _mdy(parts: Column) -> Column:
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(F.size(parts) == 3, _joined(three, one, two))


def date_from_parts(parts: Column, day_first: Column | bool = True) -> Column:
    """ISO always wins, then the preferred order, then the other; null when none fits.

    ``day_first`` may be a column, so that a whole source can be read in one order.
    """
    iso, dmy, mdy = _iso(parts), _dmy(parts), _mdy(parts)
    if isinstance(day_first, bool):
        return F.coalesce(iso, dmy, mdy) if day_first else F.coalesce(iso, mdy, dmy)
    return F.coalesce(iso, F.when(day_first, F.coalesce(dmy, mdy)).otherwise(F.coalesce(mdy, dmy)))


def parse_date(c: Column, day_first: Column | bool = True) -> Column:
    return date_from_parts(date_parts(c), day_first)


def only_day_first(parts: Column) -> Column:
    """True for a cell that makes sense only with the day before the month."""
    return _dmy(parts).isNotNull() & _mdy(parts).isNull()


def only_month_first(parts: Column) -> Column:
    """True for a cell that makes sense only with the month before the day."""
    return _mdy(parts).isNotNull() & _dmy(parts).isNull()


def safe_key(c: Column) -> Column:
    """A key fit for a file name."""
    return F.regexp_replace(c.cast("string"), "[^A-Za-z0-9_-]", "_")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def order_text(*parts: Column) -> Column:
    """``(1, 0, 1)``"""
    return F.format_string("(" + ", ".join(["%d"] * len(parts)) + ")", *parts)


def hash_preview(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.substring(c, 1, 12), F.lit("...")))


def date_range_text(start: Column, end: Column) -> Column:
    """``from A to B``; a missing end is spelled None."""
    none = F.lit("None")
    return F.concat(F.lit("from "), F.coalesce(start.cast("string"), none), F.lit(" to "), F.coalesce(end.cast("string"), none))


def money_text(c: Column) -> Column:
    """Thousands separators and two decimals; a missing value is spelled N/A."""
    return F.coalesce(F.format_number(c, 2), F.lit("N/A"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def folder_value(value: Column) -> Column:
    """A partition value as it stands in the folder's name: signs a path can't hold as % and two digits."""
    # The signs that partitioned writes escape.
    escaped = r"[\x01-\x1f\x7f\"#%'*/:=?\\\\{\[\]^]"
    signs = F.regexp_extract_all(value, F.lit(r"(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(signs, lambda c: F.when(c.rlike(escaped), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)), "")
