"""Numbers and names for reports."""

from __future__ import annotations

from collections.abc import Sequence

#: What ends an abbreviated number, by its size.
SUFFIXES = ((1e9, "G"), (1e6, "M"), (1e3, "k"))


def abbreviated(value: float) -> str:
    """1234 as 1.2k, 3000000 as 3M: one decimal under 100 where it says something."""
    size, suffix = next(((s, x) for s, x in SUFFIXES if value >= s), (1.0, ""))
    v = value / size
    return f"{v:.0f}{suffix}" if v >= 100 or abs(v - round(v)) < 0.05 else f"{v:.1f}{suffix}"


def clock(seconds: float) -> str:
    """Hours, minutes and seconds; dashes for what can't be a duration."""
    if not 0 <= seconds < 100 * 3600:
        return "--:--:--"
    minutes, s = divmod(int(seconds), 60)
    return f"{minutes // 60:02d}:{minutes % 60:02d}:{s:02d}"


def some(names: Sequence[str], limit: int) -> str:
    """The first names, and how many more there are."""
    shown = ", ".join(names[:limit])
    return shown if len(names) <= limit else f"{shown}, ... and {len(names) - limit} more"
