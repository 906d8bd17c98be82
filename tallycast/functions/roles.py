"""Which column is the date, the amount, the entity: decided on the schema only, no data is read."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import fixed


class MissingColumn(ValueError):
    """No column of the ledger can play a needed role."""


@dataclass(frozen=True)
class Roles:
    date: str
    amount: str
    entity: str | None = None


def normalise_header(df: DataFrame, lower: bool = True) -> DataFrame:
    """Trim the column names, and lower them unless told otherwise."""
    names = [c.strip().lower() if lower else c.strip() for c in df.columns]
    return df.toDF(*names)


def first_with_word(columns: Iterable[str], words: Iterable[str]) -> str | None:
    """The first column, in column order, whose name holds any of the words."""
    words = list(words)
    return next((c for c in columns if any(w in c for w in words)), None)


def entity_column(columns: list[str], style: str) -> str | None:
    """The entity column; ``by_code`` prefers named codes over any column with the plain word."""
    if style != "by_code":
        return first_with_word(columns, fixed.ENTITY_WORDS_SPLIT)

    def named(c: str) -> bool:
        companion = fixed.CODE_WORD in c and any(w in c for w in fixed.CODE_COMPANIONS)
        return companion or any(w in c for w in fixed.ENTITY_WORDS_BY_CODE)

    return next(filter(named, columns), None) or first_with_word(columns, [fixed.CODE_WORD])


def detect_roles(columns: list[str], style: str = "service", positional: str | None = None) -> Roles:
    """Roles by keyword. ``positional`` fills gaps: ``third`` (amount is the third column) or
    ``ends`` (date is the first column, amount the last)."""
    date = first_with_word(columns, fixed.DATE_WORDS[style])
    amount = first_with_word(columns, fixed.AMOUNT_WORDS[style])
    entity = entity_column(columns, style) if style in ("split", "by_code") else None
    if positional == "third" and amount is None and len(columns) >= 3:
        amount = columns[2]
    if positional == "ends":
        date = date or columns[0]
        amount = amount or columns[-1]
    wanted = {"date": date, "amount": amount}
    if style in ("split", "by_code"):
        wanted["entity"] = entity
    missing = [role for role, column in wanted.items() if column is None]
    if missing:
        raise MissingColumn(f"no column for {', '.join(missing)} among {columns}")
    return Roles(date=date, amount=amount, entity=entity)
