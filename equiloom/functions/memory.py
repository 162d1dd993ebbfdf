"""Memory of Python tasks that read texts through Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def each_text(column: pa.Array) -> Iterator[str | None]:
    """The texts in turn, one at a time as Python's own string."""
    for x in column:
        yield x.as_py()


def give_back() -> None:
    """Return what a finished batch has left: Python workers live on and would
    hold it through all that comes after."""
    pa.default_memory_pool().release_unused()
