"""Least squares with bounds from one aggregate: a table of any size gives a few sums of products, and those
are solved for at most a handful of variables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_equations(df: DataFrame, columns: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the columns with each other and with the target; rows with a null in any are left out."""
    whole = df.dropna(subset=[*columns, target])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = whole.agg(
        *[F.coalesce(F.sum(F.col(columns[i]) * F.col(columns[j])), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs],
        *[F.coalesce(F.sum(F.col(c) * F.col(target)), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(columns)],
    ).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = one[f"g{i}_{j}"]
    return g, np.array([one[f"r{i}"] for i in range(len(columns))])


def bounded(g: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The x within [low, high] that minimises x g x / 2 - r x, by an active set: variables are freed where the slope points
    inside, and go back to the bound that a step towards the free minimum meets first."""
    x, free = np.array(low, float), np.zeros(len(r), bool)
    scale = np.maximum(np.sqrt(np.diag(g)), 1e-300)
    for _ in range(50 * (len(r) + 1)):
        slope = (g @ x - r) / scale
        gain = np.where(free, 0.0, np.where(x <= low, -slope, slope))
        gain[(low >= high) | ((x > low) & (x < high) & ~free)] = 0.0
        best = int(np.argmax(gain))
        if gain[best] <= 1e-10 * max(1.0, np.abs(r / scale).max(initial=0.0)):
            return x
        free[best] = True
        while free.any():
            at = np.flatnonzero(free)
            want = np.linalg.lstsq(g[np.ix_(at, at)], r[at] - g[np.ix_(at, np.flatnonzero(~free))] @ x[~free], rcond=None)[0]
            step = want - x[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (high[at] - x[at]) / step, np.where(step < 0, (low[at] - x[at]) / step, np.inf))
            t = min(1.0, room.min(initial=np.inf))
            x[at] = np.clip(x[at] + t * step, low[at], high[at])
            if t >= 1.0:
                break
            met = at[int(np.argmin(room))]
            x[met] = high[met] if step[int(np.argmin(room))] > 0 else low[met]
            free[met] = False
    return x


def bounded_least_squares(df: DataFrame, columns: list[str], target: str, low: list[float], high: list[float]) -> dict[str, float]:
    """The coefficients within their bounds that leave the least sum of squares."""
    g, r = normal_equations(df, columns, target)
    return dict(zip(columns, bounded(g, r, np.array(low, float), np.array(high, float)).tolist(), strict=True))
