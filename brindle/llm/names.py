"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, taken: Iterable[str]) -> str:
    """name, with underlines put behind it until it differs from all taken names, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
