"""Exponential smoothing of one short series; called once per series inside a Spark group."""

from __future__ import annotations

import itertools

import numpy as np

SEASON = 7


def _run(y: np.ndarray, params: np.ndarray, trend: bool, season: int) -> tuple[np.ndarray, ...]:
    """Additive recursion for many (alpha, beta, gamma) rows at once; returns errors and end state."""
    alpha, beta, gamma = params.T
    k = len(params)
    if season and len(y) >= 2 * season:
        first, second = y[:season].mean(), y[season : 2 * season].mean()
        slope = (second - first) / season
        cycle = np.tile(y[:season] - first - slope * (np.arange(season) - (season - 1) / 2), (k, 1))
        start = first - slope * (season + 1) / 2
    else:
        season, cycle = 0, None
        slope, start = (y[1] - y[0] if len(y) > 1 else 0.0), y[0]
    level = np.full(k, start, dtype=float)
    rise = np.full(k, slope if trend else 0.0, dtype=float)
    if not season:
        level = level - rise
    sse = np.zeros(k)
    for i, value in enumerate(y):
        seasonal = cycle[:, i % season] if season else 0.0
        expected = level + rise
        sse += (value - expected - seasonal) ** 2
        new_level = alpha * (value - seasonal) + (1 - alpha) * expected
        if season:
            cycle[:, i % season] = gamma * (value - expected) + (1 - gamma) * seasonal
        if trend:
            rise = beta * (new_level - level) + (1 - beta) * rise
        level = new_level
    return sse, level, rise, cycle


def smooth_forecast(y: np.ndarray, horizon: int, trend: bool, seasonal: bool) -> np.ndarray:
    """Forecast with the smoothing weights of least squared one-step error, never below zero.

    A coarse grid of weights is narrowed three times around its best point.
    """
    y = np.asarray(y, dtype=float)
    season = SEASON if seasonal else 0
    axes = [
        np.linspace(0.05, 0.95, 7),
        np.linspace(0.0, 0.9, 5) if trend else np.zeros(1),
        np.linspace(0.0, 0.9, 5) if season else np.zeros(1),
    ]
    width = 0.15
    for _ in range(4):
        params = np.array(list(itertools.product(*axes)))
        sse, level, rise, cycle = _run(y, params, trend, season)
        best = int(np.argmin(sse))
        centre = params[best]
        axes = [
            np.unique(np.clip(np.linspace(c - width, c + width, 5), 0.0 if j else 0.01, 0.99)) if len(axes[j]) > 1 else axes[j]
            for j, c in enumerate(centre)
        ]
        width /= 3
    steps = np.arange(1, horizon + 1)
    out = level[best] + rise[best] * steps
    if cycle is not None:
        out = out + cycle[best][(len(y) + steps - 1) % season]
    return np.maximum(0.0, out)
