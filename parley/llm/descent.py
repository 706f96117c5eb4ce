"""A small limited-memory quasi-Newton minimiser for models fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 100, memory: int = 8
) -> np.ndarray:
    """A minimum of a smooth convex loss, given with its gradient."""
    x = start.astype(float)
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max(initial=0.0) < 1e-6:
            break
        direction, saved = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ direction / (s @ y)
            direction -= a * y
            saved.append(a)
        if steps:
            s, y = steps[-1]
            direction *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(saved), strict=True):
            direction += s * (a - y @ direction / (s @ y))
        rate = 1.0 if steps else 1.0 / max(1.0, np.abs(slope).sum())
        descent = slope @ direction
        for _ in range(30):
            there = x - rate * direction
            new_value, new_slope = loss(there)
            if np.isfinite(new_value) and new_value <= value - 1e-4 * rate * descent:
                break
            rate /= 2
        else:
            break
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        x, value, slope = there, new_value, new_slope
        if done:
            break
    return x
