"""Age texts such as ``7d`` or ``1h30m``."""

from __future__ import annotations

import re
from fractions import Fraction

SECOND = 1_000_000_000

# Nanoseconds per duration unit.
UNITS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": SECOND,
    "m": 60 * SECOND,
    "h": 3600 * SECOND,
}
DAY = 24 * UNITS["h"]
LONGEST = 2**63 - 1

_DAYS = re.compile(r"([0-9]+(?:\.[0-9]+)?)d")
_PART = re.compile(r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)")
_WHOLE = re.compile(rf"(?:{_PART.pattern})+")


def parse_age(text: str) -> int:
    """Nanoseconds of a non-negative age: a day count (``7d``, ``1.5d``) or a duration (``168h``, ``1h30m``)."""
    days = _DAYS.fullmatch(text)
    body = text.removeprefix("+")
    if days:
        total = int(Fraction(days.group(1)) * DAY)
    elif body in ("0", "-0"):
        total = 0
    elif _WHOLE.fullmatch(body):
        total = sum(int(Fraction(number) * UNITS[unit]) for number, unit in _PART.findall(body))
    else:
        raise ValueError(f"invalid non-negative duration {text!r}")
    if total > LONGEST:
        raise ValueError(f"duration {text!r} is too long")
    return total


def whole_seconds(nanoseconds: int) -> int:
    """Window edges are cut to whole seconds."""
    return nanoseconds // SECOND
