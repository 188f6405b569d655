"""Names of intervals and horizons."""

from __future__ import annotations

import re

#: Minutes of a unit.
UNITS = {"m": 1, "h": 60, "d": 1440, "w": 10080}
#: Minutes of a bar that horizons are counted in.
BAR = 15


def interval(name: str) -> str:
    """A candle interval such as 15m, 1h, 1d or 1w as Spark's interval of minutes."""
    found = re.fullmatch(r"(\d+)([mhdw])", name.strip())
    if not found or not int(found[1]):
        raise ValueError(f"unknown interval: {name!r}")
    return f"{int(found[1]) * UNITS[found[2]]} minutes"


def horizon(name: str | int) -> int:
    """Bars of a horizon such as m15, h4 or d1, or a number of bars."""
    text = str(name).strip().lower()
    found = re.fullmatch(r"([mhd])(\d+)", text)
    minutes = UNITS[found[1]] * int(found[2]) if found else BAR * int(text) if text.isdigit() else 0
    if not minutes or minutes % BAR:
        raise ValueError(f"unknown horizon: {name!r}")
    return minutes // BAR


def horizon_name(bars: int) -> str:
    """The name of a number of bars in its largest whole unit of minutes, hours or days."""
    minutes = bars * BAR
    unit = "d" if minutes % UNITS["d"] == 0 else "h" if minutes % UNITS["h"] == 0 else "m"
    return f"{unit}{minutes // UNITS[unit]}"
