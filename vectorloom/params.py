"""Parameter guards shared by every operator."""

from __future__ import annotations

import math
from typing import Any

from .errors import invalid


def int_param(params: dict, name: str, default: int, low: int | None = 1, high: int | None = None) -> int:
    value = params.get(name, default)
    if isinstance(value, bool) or value is None:
        raise invalid(f"{name} must be an integer")
    try:
        value = int(value)
    except (TypeError, ValueError):
        raise invalid(f"{name} must be an integer") from None
    _bounds(name, value, low, high)
    return value


def float_param(params: dict, name: str, default: float, low: float | None = None, high: float | None = None) -> float:
    value = params.get(name, default)
    if isinstance(value, bool) or value is None:
        raise invalid(f"{name} must be a finite number")
    try:
        value = float(value)
    except (TypeError, ValueError):
        raise invalid(f"{name} must be a finite number") from None
    if not math.isfinite(value):
        raise invalid(f"{name} must be a finite number")
    _bounds(name, value, low, high)
    return value


def choice(params: dict, name: str, default: str, allowed: tuple[str, ...]) -> str:
    value = str(params.get(name) or default).lower()
    if value not in allowed:
        raise invalid(f"{name} must be one of {', '.join(allowed)}")
    return value


def seed_param(params: dict) -> int:
    return int_param(params, "seed", 42, 0)


def _bounds(name: str, value: Any, low: Any, high: Any) -> None:
    if low is not None and value < low:
        raise invalid(f"{name} must be >= {low}")
    if high is not None and value > high:
        raise invalid(f"{name} must be <= {high}")
