"""Checks of arguments on the driver: the right type, in range, not empty; a message that names the argument."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any


def boolean(value: Any, name: str) -> bool:
    if not isinstance(value, bool):
        raise TypeError(f"{name} must be a bool, not {type(value).__name__}")
    return value


def _in_range(value: Any, name: str, low: Any, high: Any) -> Any:
    if low is not None and value < low or high is not None and value > high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value


def integer(value: Any, name: str, low: int | None = None, high: int | None = None) -> int:
    """A bool is no integer."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an int, not {type(value).__name__}")
    return _in_range(value, name, low, high)


def number(value: Any, name: str, low: float | None = None, high: float | None = None) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number, not {type(value).__name__}")
    return float(_in_range(value, name, low, high))


def string(value: Any, name: str, among: Iterable[str] | None = None) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{name} must be a str, not {type(value).__name__}")
    if among is not None and value not in (allowed := list(among)):
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
    return value


def sequence(value: Any, name: str, of: type | None = None) -> list:
    if not isinstance(value, list):
        raise TypeError(f"{name} must be a list, not {type(value).__name__}")
    if of is not None and (bad := [v for v in value if not isinstance(v, of)]):
        raise TypeError(f"{name} must hold {of.__name__}s, not {bad[0]!r}")
    return value


def mapping(value: Any, name: str, keys: Iterable[str] = ()) -> dict:
    if not isinstance(value, dict):
        raise TypeError(f"{name} must be a dict, not {type(value).__name__}")
    if missing := [k for k in keys if k not in value]:
        raise ValueError(f"{name} lacks {missing}")
    return value
