"""Column names that a table doesn't have yet."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem, with underscores before it until no column, in whatever case, has it."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
