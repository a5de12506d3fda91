"""Squared-loss lasso paths with a duality gap, compact refits and bootstrap intervals (numpy on the driver)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from conjunct.plans.solver import poisson_glm


@dataclass
class LassoPoint:
    tau: float
    b: float
    w: np.ndarray
    gap: float
    kkt: float


def alpha_max(x: np.ndarray, y: np.ndarray) -> float:
    """The least penalty whose solution is the mean alone."""
    return float(np.abs(x.T @ (y - y.mean())).max() / len(y)) if x.shape[1] else 0.0


def lasso_path(x: np.ndarray, y: np.ndarray, taus: list[float], tol: float = 1e-8, rounds: int = 20_000) -> list[LassoPoint]:
    """1 / (2 n) |y - b - Xw|^2 + tau * alpha_max |w|_1, each point started at the one before.

    A point is done when its duality gap is at most tol times the responses' variance.
    """
    n = len(y)
    centre = x.mean(axis=0)
    xc, yc = x - centre, y - y.mean()
    norms = (xc * xc).sum(axis=0) / n
    top, w, r, out = alpha_max(x, y), np.zeros(x.shape[1]), yc.copy(), []
    for tau in taus:
        lam = tau * top
        for _ in range(rounds):
            c = xc.T @ r / n
            gap = _gap(yc, r, w, c, lam)
            if gap <= tol * max(float(yc @ yc) / n, 1e-300):
                break
            for j in np.flatnonzero(norms > 0):
                z = xc[:, j] @ r / n + norms[j] * w[j]
                new = math.copysign(max(abs(z) - lam, 0.0), z) / norms[j]
                if new != w[j]:
                    r += xc[:, j] * (w[j] - new)
                    w[j] = new
        c = xc.T @ r / n
        kkt = float(np.where(w == 0, np.maximum(np.abs(c) - lam, 0), np.abs(c - lam * np.sign(w))).max()) if len(w) else 0.0
        out.append(LassoPoint(tau, float(y.mean() - centre @ w), w.copy(), _gap(yc, r, w, c, lam), kkt))
    return out


def _gap(y: np.ndarray, r: np.ndarray, w: np.ndarray, c: np.ndarray, lam: float) -> float:
    n = len(y)
    peak = float(np.abs(c).max()) if len(c) else 0.0
    s = min(1.0, lam / peak) if peak else 1.0
    primal = float(r @ r) / (2 * n) + lam * float(np.abs(w).sum())
    dual = (float(y @ y) - float((y - s * r) @ (y - s * r))) / (2 * n)
    return max(0.0, primal - dual)


def compact_refit(x: np.ndarray, y: np.ndarray, order: np.ndarray, folds: np.ndarray, sizes=(8, 20, 50, 100), alphas=(0.01, 0.1, 1.0)) -> tuple[int, float]:
    """(size, alpha): Poisson ridge on the first columns of an order; the smallest size within one standard error of the best."""
    found = []
    for k in sizes:
        cols = order[: min(k, len(order))]
        best = None
        for a in alphas:
            errors = []
            for f in np.unique(folds):
                b, w = poisson_glm(x[folds != f][:, cols], y[folds != f], a)
                errors.append(math.sqrt(((np.exp(b + x[folds == f][:, cols] @ w) - y[folds == f]) ** 2).mean()))
            score = float(np.mean(errors)), float(np.std(errors, ddof=1) / math.sqrt(len(errors))), a
            best = score if best is None or score[0] < best[0] else best
        found.append((k, *best))
    least = min(found, key=lambda p: p[1])
    return next((k, a) for k, m, _, a in found if m <= least[1] + least[2])


def bootstrap_intervals(y: np.ndarray, one: np.ndarray, two: np.ndarray, draws: int = 2000, seed: int = 42) -> dict[str, float]:
    """2.5 and 97.5 percentiles of the difference of two models' rmse over paired resamples of rows, and how often it is positive."""
    rng = np.random.default_rng(seed)
    a, b = (y - one) ** 2, (y - two) ** 2
    difference = np.empty(draws)
    for k in range(draws):
        rows = rng.integers(0, len(y), len(y))
        difference[k] = math.sqrt(a[rows].mean()) - math.sqrt(b[rows].mean())
    low, high = np.nanpercentile(difference, [2.5, 97.5])
    return {"low": float(low), "high": float(high), "positive": float((difference > 0).mean())}


def run_lasso(x: np.ndarray, y: np.ndarray, folds: np.ndarray, taus: list[float]) -> tuple[LassoPoint, list[float]]:
    """The path's point at the tau of least mean fold rmse (the largest of equal ones), fitted to all rows, and the means."""
    means = np.zeros(len(taus))
    every = np.unique(folds)
    for f in every:
        fit, held = folds != f, folds == f
        for k, p in enumerate(lasso_path(x[fit], y[fit], taus)):
            means[k] += math.sqrt(((p.b + x[held] @ p.w - y[held]) ** 2).mean()) / len(every)
    chosen = int(np.argmin(means))
    return lasso_path(x, y, taus[: chosen + 1])[-1], means.tolist()


def record(name: str, fit, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> dict:
    """What a model (fit(x, y) -> predict) gives on held-out rows, or why it failed; one failure never stops a study."""
    try:
        return {"method": name, "status": "complete", "prediction": [float(v) for v in fit(x, y)(held)], "error": None}
    except Exception as e:  # noqa: BLE001  the record is the report
        return {"method": name, "status": "failed", "prediction": None, "error": f"{type(e).__name__}: {e}"}
