"""Minimising smooth functions of a few thousand weights."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 120, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with halving steps; ``f`` gives value and gradient. Deterministic."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0) < tolerance:
            break
        way, alphas = slope.copy(), []
        for s, y, r in reversed(moves):
            alphas.append(r * (s @ way))
            way -= alphas[-1] * y
        if moves:
            s, y, _ = moves[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, y, r), a in zip(moves, reversed(alphas), strict=True):
            way += s * (a - r * (y @ way))
        size, down = 1.0, slope @ way
        if down <= 0:
            way, down, moves = slope, slope @ slope, []
        while size > 1e-10:
            new = x - size * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x
