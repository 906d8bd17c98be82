"""Words of texts as columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: words between ASCII white space, and words of letters and digits (all of non-ASCII counts as letters).
SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are; null stays null.

    ``lower`` is quick but knows other alphabets too, so it serves the texts that are all ASCII.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str = SPACED) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def window_hash(array: str, start: Column, width: int) -> Column:
    """Hash of the ``width`` words from the 0-based ``start`` on, or of as many as are left.

    Each word is taken by its place: ``slice`` inside a lambda copies the whole array every time.
    """
    return F.xxhash64(*[F.get(array, start + i) for i in range(width)])
