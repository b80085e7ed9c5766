"""Column names of an operator's own that cannot meet those of its input."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many ``_`` behind it as it takes to be no column; case does not tell names apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
