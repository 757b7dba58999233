"""Results in a form that can be compared."""

from __future__ import annotations

import math
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def rows(frame):
    """Rows of a pandas frame in a form that can be compared: columns by name, doubles to six places, dates as text."""
    def one(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0) if math.isfinite(v) else repr(v)
        return str(v)[:10] if hasattr(v, "year") else repr(v.item() if hasattr(v, "item") else v)

    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
