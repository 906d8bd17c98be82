"""What Python workers hold on to. Spark hands the same few workers to one stage after the other, whatever those run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave, from task to task, until a function that doesn't keep ``key`` runs in this worker."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(but: Any = None) -> None:
    """Drops all that is kept except ``but``, and gives the memory that Arrow holds for later back to the machine."""
    for key in [k for k in _kept if k != but]:
        del _kept[key]
    pa.default_memory_pool().release_unused()


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Any = None) -> Callable:
    """``function`` for ``mapInArrow``: what others have kept goes before it begins, what Arrow holds for later when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from function(batches)
        finally:
            forget(keeps)

    return run
