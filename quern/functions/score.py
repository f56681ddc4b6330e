"""Decay, reinforcement and the five-part memory score as columns.

Parameters are checked when a plan is built (ValueError); values in columns are checked when it runs (the job fails).
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400.0


@dataclass(frozen=True)
class Weights:
    """Weights of the parts of a memory score (defaults are fixed values)."""

    semantic: float = 0.5
    recency: float = 0.2
    activation: float = 0.15
    importance: float = 0.1
    graph: float = 0.05


PARTS = ("semantic", "recency", "activation", "importance", "graph")


def checked(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights by part; negative ones, ones that aren't numbers, or none above 0 raise ValueError."""
    out = {part: float(weights.get(part, 0.0)) for part in PARTS}
    if not all(w >= 0 for w in out.values()) or not any(out.values()):
        raise ValueError("weights must not be negative, nor all zero")
    return out


def _within(value: Column, low: float | None, high: float | None, name: str) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return F.when(bad, F.raise_error(F.lit(f"{name} is out of range")).cast("double")).otherwise(value)


def decay(start: Column, rate: float, seconds: Column) -> Column:
    """start * exp(-rate * seconds); start within [0, 1], rate and seconds not negative."""
    if rate < 0:
        raise ValueError("rate must not be negative")
    return _within(start, 0, 1, "start") * F.exp(-F.lit(float(rate)) * _within(seconds, 0, None, "seconds"))


def half_life(rate: float | Column) -> float | Column:
    """Seconds in which an activation halves, of a rate or of a column of rates."""
    if isinstance(rate, Column):
        return F.log(F.lit(2.0)) / F.when(rate > 0, rate).otherwise(F.raise_error(F.lit("rate must be positive")).cast("double"))
    if rate <= 0:
        raise ValueError("rate must be positive")
    return math.log(2) / rate


def rate_of(half_life_s: float = 30 * DAY_S) -> float:
    if half_life_s <= 0:
        raise ValueError("half-life must be positive")
    return math.log(2) / half_life_s


def reinforce(activation: Column, reward: float = 0.1) -> Column:
    """An access raises the activation by the reward, to 1 at most."""
    if reward < 0:
        raise ValueError("reward must not be negative")
    return F.least(F.lit(1.0), _within(activation, 0, 1, "activation") + reward)


def age_seconds(created: Column, as_of: Column) -> Column:
    """Seconds from created to as_of, fractions included, 0 for the future; null without a creation time."""
    passed = (F.unix_micros(as_of) - F.unix_micros(created)) / 1e6
    return F.when(passed < 0, F.lit(0.0)).otherwise(passed)


def recency(created: Column, as_of: Column, half_life_s: float = 30 * DAY_S) -> Column:
    """Decay of 1 over the age; 0 without a creation time."""
    return F.coalesce(decay(F.lit(1.0), rate_of(half_life_s), age_seconds(created, as_of)), F.lit(0.0))


def memory_score(parts: dict[str, Column], weights: Weights | None = None) -> tuple[Column, Column]:
    """(score, parts as a struct): the weighted sum of parts within [0, 1]; parts not given are 0."""
    share = checked(asdict(weights or Weights()))
    values = {p: _within(parts.get(p, F.lit(0.0)), 0, 1, p) for p in PARTS}
    total = sum((F.lit(share[p]) * c for p, c in values.items()), F.lit(0.0))
    return total, F.struct(*[c.alias(p) for p, c in values.items()])
