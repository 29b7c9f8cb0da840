"""Durations such as ``90s`` or ``1h``, and the settings of pattern detection."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str) -> int:
    """An integer and one of s, m, h and d."""
    if len(text) < 2 or text[-1] not in _SECONDS or not text[:-1].isdigit():
        raise ValueError(f"not a duration: {text!r}")
    return int(text[:-1]) * _SECONDS[text[-1]]


@dataclass
class Seasonal:
    enabled: bool = True
    min_data_points: int = 24
    period: int = 86400
    method: str = "additive"


@dataclass
class Multivariate:
    enabled: bool = True
    correlation_threshold: float = 0.7
    groups: list[list[str]] = field(default_factory=list)
    method: str = "mahalanobis"
    threshold: float = 3.0


@dataclass
class ChangePoint:
    enabled: bool = True
    threshold: float = 2.0
    method: str = "cusum"
    penalty: float = 1.0


@dataclass
class MovingWindow:
    enabled: bool = True
    window_size: int = 3600
    step_size: int = 900
    method: str = "volatility"
    threshold: float = 1.5


@dataclass
class Detection:
    seasonal: Seasonal = field(default_factory=Seasonal)
    multivariate: Multivariate = field(default_factory=Multivariate)
    changepoint: ChangePoint = field(default_factory=ChangePoint)
    moving_window: MovingWindow = field(default_factory=MovingWindow)


def load(path: str | None = None) -> Detection:
    """Settings of a TOML file with a table for each field; what it lacks keeps its default.

    Tables and keys that steer nothing are ignored.
    """
    settings = Detection()
    if path is None:
        return settings
    with open(path, "rb") as file:
        given = tomllib.load(file)
    for section in fields(settings):
        part = getattr(settings, section.name)
        for key, value in given.get(section.name, {}).items():
            if hasattr(part, key):
                setattr(part, key, value)
    return settings
