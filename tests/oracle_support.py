"""What tests compare rows by."""

from __future__ import annotations

from pathlib import Path

SMALL = Path("/root/testdata/sf0.001")


def comparable(rows) -> list[tuple]:
    """Rows as sorted tuples of text, floats in six places."""

    def plain(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in rows)
