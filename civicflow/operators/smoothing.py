"""Exponential-smoothing fits of one series, over all points of a parameter grid at once (numpy).

For fixed smoothing parameters the one-step errors are linear in the initial states:
``e = e0 - X x``, where ``e0`` are the errors from a zero start and a column of ``X`` holds the forecasts
that a unit of one initial state gives on zero data. Least squares over ``x`` is then exact:

* trend models (``x`` = level, trend): the 2x2 normal equations are summed along the series;
* the seasonal model (``x`` = level, trend and one value a season, these summing to zero): a unit in the
  season of step j acts as one in the first season does, j - 1 steps later, so the 52 columns are
  shifts of one response and the normal equations come from three simulated responses.

The functions take arrays over grid points, so a step of the series is one vector operation.
"""

from __future__ import annotations

import numpy as np

# Candidate model labels, season length.
ADD = "Add only"
DAMPED = "Damped Add"
SEASONAL = "Add+Seasonal"
SEASON = 52
# Grid: coarse alpha/beta step, damping values, fine step / half-width.
COARSE_STEP = 0.05
N_ALPHA = 19          # alpha = 0.05 .. 0.95
N_BETA = 20           # beta  = 0.00 .. 0.95, kept only when beta <= alpha
PHI_LO, PHI_STEP, N_PHI = 0.80, 0.045, 5  # phi = 0.80 .. 0.98
FINE_STEP, FINE_HALF = 0.01, 4
PHI_FINE_STEP, PHI_FINE_HALF, PHI_MAX = 0.01, 2, 0.995
# Seasonal grid: coarse, then one neighbour on each side per parameter and round, down to the fine step.
S_N_ALPHA, S_ALPHA_STEP = 9, 0.1
S_BETAS = (0.0, 0.05)
S_GAMMAS = (0.0, 0.05, 0.1, 0.2, 0.3)
S_ROUNDS = (0.05, 0.02, 0.01)
RIDGE = 1e-9
MIN_SSE = 1e-12
# Free parameters in the AIC: alpha + l0, beta + b0; phi; gamma + one initial value a season.
N_PARAMS = {ADD: 4, DAMPED: 5, SEASONAL: 5 + SEASON}


def trend_fits(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, phi: np.ndarray) -> dict[str, np.ndarray]:
    """Least-squares level and trend, error sum and end state of each (alpha, beta, phi)."""
    ab = alpha * beta
    zero, one = np.zeros_like(alpha), np.ones_like(alpha)
    lz, bz, lu, bu, lv, bv = zero, zero, one, zero, zero, one
    see, p, q, a, c, d = (np.zeros_like(alpha) for _ in range(6))
    for value in y:
        fz, fu, fv = lz + phi * bz, lu + phi * bu, lv + phi * bv
        e = value - fz
        lz, bz = fz + alpha * e, phi * bz + ab * e
        lu, bu = fu - alpha * fu, phi * bu - ab * fu
        lv, bv = fv - alpha * fv, phi * bv - ab * fv
        see, p, q = see + e * e, p + e * fu, q + e * fv
        a, c, d = a + fu * fu, c + fu * fv, d + fv * fv
    ridge = RIDGE * (a + d)
    det = (a + ridge) * (d + ridge) - c * c
    l0 = (p * (d + ridge) - q * c) / det
    b0 = ((a + ridge) * q - c * p) / det
    return {"l0": l0, "b0": b0, "sse": np.maximum(see - l0 * p - b0 * q, MIN_SSE),
            "level": lz + l0 * lu + b0 * lv, "trend": bz + l0 * bu + b0 * bv}


def _forecasts(y, alpha, beta, gamma, level, trend, season):
    """One-step forecasts (step, grid point) of the seasonal model from given initial states, and the end state."""
    ab, m = alpha * beta, season.shape[0]
    season, out = season.copy(), np.empty((len(y), len(alpha)))
    for t, value in enumerate(y):
        base, s = level + trend, season[t % m]
        out[t] = base + s
        e = value - out[t]
        level, trend = base + alpha * e, trend + ab * e
        season[t % m] = s + gamma * e
    return out, level, trend, np.roll(season, -(len(y) % m), axis=0)


def seasonal_fits(y: np.ndarray, alpha: np.ndarray, beta: np.ndarray, gamma: np.ndarray, m: int) -> dict[str, np.ndarray]:
    """Least-squares level, trend and seasons, error sum and end state of each (alpha, beta, gamma)."""
    points, n = len(alpha), len(y)
    zero, one, none = np.zeros(points), np.ones(points), np.zeros((m, points))
    first = none.copy()
    first[0] = 1.0
    flat = np.zeros(n)
    e0 = y[:, None] - _forecasts(y, alpha, beta, gamma, zero, zero, none)[0]
    by_level = _forecasts(flat, alpha, beta, gamma, one, zero, none)[0]
    by_trend = _forecasts(flat, alpha, beta, gamma, zero, one, none)[0]
    by_season = _forecasts(flat, alpha, beta, gamma, zero, zero, first)[0]
    padded = np.concatenate([np.zeros((m - 1, points)), by_season])
    shift = np.arange(n)[:, None] + (m - 1) - np.arange(m)[None, :]  # row of ``padded`` for (step, season)
    states = np.empty((m + 2, points))
    for k in range(points):
        columns = padded[shift, k]
        x = np.column_stack([by_level[:, k], by_trend[:, k], columns[:, :-1] - columns[:, -1:]])
        gram = x.T @ x
        gram[np.diag_indices_from(gram)] *= 1.0 + RIDGE
        states[:-1, k] = np.linalg.solve(gram, x.T @ e0[:, k])
    states[-1] = -states[2:-1].sum(axis=0)
    fitted, level, trend, season = _forecasts(y, alpha, beta, gamma, states[0], states[1], states[2:])
    return {"l0": states[0], "b0": states[1], "season0": states[2:].T, "sse": np.maximum(((y[:, None] - fitted) ** 2).sum(axis=0), MIN_SSE),
            "level": level, "trend": trend, "season": season.T}


def coarse_points(damped: bool) -> list[tuple[float, float, float, float]]:
    """(alpha, beta, phi, gamma) of the first search of a trend model."""
    phis = [PHI_LO + k * PHI_STEP for k in range(N_PHI)] if damped else [1.0]
    return [(i * COARSE_STEP, j * COARSE_STEP, phi, 0.0) for phi in phis for i in range(1, N_ALPHA + 1) for j in range(N_BETA)
            if j * COARSE_STEP <= i * COARSE_STEP]


def fine_points(best, damped: bool):
    """The finer grid around the best coarse point of a trend model (the centre included)."""
    alpha, beta, phi, _ = best
    near = range(-FINE_HALF, FINE_HALF + 1)
    phis = [phi + k * PHI_FINE_STEP for k in range(-PHI_FINE_HALF, PHI_FINE_HALF + 1)] if damped else [1.0]
    points = [(alpha + i * FINE_STEP, beta + j * FINE_STEP, p, 0.0) for i in near for j in near for p in phis]
    return [(a, b, p, g) for a, b, p, g in points if 0.0 < a < 1.0 and 0.0 <= b <= a and (not damped or PHI_LO <= p <= PHI_MAX)]


def seasonal_points(best=None, step: float = 0.0):
    """The first search of the seasonal model, or the neighbours of its best point at a step."""
    if best is None:
        points = [(i * S_ALPHA_STEP, b, 1.0, g) for i in range(1, S_N_ALPHA + 1) for b in S_BETAS for g in S_GAMMAS]
    else:
        alpha, beta, _, gamma = best
        near = (-1, 0, 1)
        points = [(alpha + i * step, beta + j * step, 1.0, gamma + k * step) for i in near for j in near for k in near]
    return [(a, b, p, g) for a, b, p, g in points if 0.0 < a < 1.0 and 0.0 <= b <= a and 0.0 <= g <= 1.0 - a]


def evaluate(y: np.ndarray, model: str, points) -> dict[str, np.ndarray]:
    """Fits of one model at (alpha, beta, phi, gamma) points, with the AIC."""
    alpha, beta, phi, gamma = (np.array(c, dtype=np.float64) for c in zip(*points))
    fits = seasonal_fits(y, alpha, beta, gamma, SEASON) if model == SEASONAL else trend_fits(y, alpha, beta, phi)
    aic = len(y) * np.log(fits["sse"] / len(y)) + 2.0 * N_PARAMS[model]
    return fits | {"alpha": alpha, "beta": beta, "phi": phi, "gamma": gamma, "aic": aic}


def best_fit(y: np.ndarray, model: str, points) -> dict:
    """The point of the smallest AIC (ties: smaller alpha, beta, phi, gamma)."""
    fits = evaluate(y, model, points)
    k = np.lexsort([fits[c] for c in ("gamma", "phi", "beta", "alpha", "aic")])[0]
    return {c: v[k].tolist() for c, v in fits.items()} | {"model": model}


def _point(fit: dict):
    return fit["alpha"], fit["beta"], fit["phi"], fit["gamma"]


def fit_series(y: np.ndarray, models) -> list[dict]:
    """The best fit of each candidate model: coarse search, then finer around the best point.

    The seasonal model is a candidate from two full seasons on."""
    out = []
    for model in (ADD, DAMPED):
        if model in models:
            coarse = best_fit(y, model, coarse_points(model == DAMPED))
            out.append(best_fit(y, model, fine_points(_point(coarse), model == DAMPED)))
    if SEASONAL in models and len(y) >= 2 * SEASON:
        fit = best_fit(y, SEASONAL, seasonal_points())
        for step in S_ROUNDS:
            fit = best_fit(y, SEASONAL, seasonal_points(_point(fit), step))
        out.append(fit)
    return out
