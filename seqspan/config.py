"""Build and query settings, and the parsers of their command-line forms."""

from __future__ import annotations

import math
from dataclasses import dataclass

UINT32_MAX = 2**32 - 1  # radii, tolerances and counts are unsigned 32-bit numbers
LAYERS = ("large", "middle", "small")
FORMAT_VERSION = 2  # fixed value: the index format this engine reads and writes


def triple(text: str, kind: type) -> tuple:
    """Exactly three comma-separated values."""
    parts = text.split(",")
    if len(parts) != 3 or any(not p.strip() for p in parts):
        raise ValueError(f"three comma-separated values are needed, not {text!r}")
    values = tuple(kind(p) for p in parts)
    if kind is int and any(not 0 <= v <= UINT32_MAX for v in values):
        raise ValueError(f"value out of range in {text!r}")
    return values


def integer32(value: str | int, name: str = "value") -> int:
    number = int(value)
    if not 0 <= number <= UINT32_MAX:
        raise ValueError(f"{name} is out of range: {value}")
    return number


@dataclass(frozen=True)
class BuildConfig:
    radii: tuple[int, int, int] = (60, 35, 15)
    beacon_ratios: tuple[float, float, float] = (0.1, 0.1, 0.1)
    max_tolerance: int = 5

    def __post_init__(self) -> None:
        if len(self.radii) != 3 or len(self.beacon_ratios) != 3:
            raise ValueError("three radii and three beacon ratios are needed")
        for r in (*self.radii, self.max_tolerance):
            integer32(r, "radius or tolerance")
        if any(not math.isfinite(x) or not 0 <= x <= 1 for x in self.beacon_ratios):
            raise ValueError("beacon ratios must lie between 0 and 1")

    @property
    def exact(self) -> bool:
        """Routing finds every window within the tolerance if every radius exceeds 2T."""
        return min(self.radii) > 2 * self.max_tolerance


@dataclass(frozen=True)
class QueryConfig:
    tolerance: int | None = None
    both_strands: bool = False
    route: str = "multilateration"

    def __post_init__(self) -> None:
        if self.route not in ("multilateration", "scan"):
            raise ValueError(f"unknown route mode: {self.route}")

    def within(self, max_tolerance: int) -> int:
        """The tolerance to use: the index's if none is given, an error above it."""
        t = max_tolerance if self.tolerance is None else integer32(self.tolerance, "tolerance")
        if t > max_tolerance:
            raise ValueError(f"tolerance {t} exceeds the index's {max_tolerance}")
        return t
