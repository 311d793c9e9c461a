"""Byte sizes and durations as text."""

from __future__ import annotations

import re

#: Each 1024 times the one before (fixed values).
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def parse_size(text: str) -> int:
    """'1.5 MB' -> 1572864. Without a unit: bytes. ValueError for anything else."""
    found = re.search(r"(\d[\d.]*)[^A-Za-z]*([A-Za-z]*)", text or "")
    if not found or found[1].count(".") > 1:
        raise ValueError(f"no size in {text!r}")
    unit = found[2].upper() or "B"
    if unit not in UNITS:
        raise ValueError(f"unknown unit {found[2]!r} in {text!r}; known: {', '.join(UNITS)}")
    return int(float(found[1]) * 1024 ** UNITS.index(unit))


def format_size(n: int, decimals: int = 2) -> str:
    if n < 0 or n >= 1024**6:
        raise ValueError("sizes go from 0 to 1024 PB")
    if n < 1024:
        return "1 byte" if n == 1 else f"{n} bytes"
    k = next(k for k in range(1, 6) if n < 1024 ** (k + 1))
    number = f"{n / 1024**k:.{decimals}f}"
    return f"{number.rstrip('0').rstrip('.') if '.' in number else number} {UNITS[k]}"


#: Seconds below which a unit is used, seconds in it, decimals, name (fixed values).
_SPANS = ((1, 1e-3, 2, "ms"), (10, 1e-3, 1, "ms"), (300, 1, 2, "sec"), (5400, 60, 2, "min"), (129_600, 3600, 2, "hrs"))


def format_span(seconds: float) -> str:
    seconds = abs(seconds)
    for below, unit, decimals, name in _SPANS:
        if seconds < below:
            return f"{seconds / unit:,.{decimals}f} {name}"
    days, rest = divmod(seconds, 86_400)
    return f"{int(days):,} day{'s' if days > 1 else ''}, {rest / 3600:,.1f} hrs."
