"""Elastic-net Poisson regression on a working set, and dual certificates.

The objective is sum(mu - y eta) + lam |w|_1 + kappa / 2 |w|^2 with mu = exp(eta) and eta = b + X w. The intercept is
profiled out, and proximal Newton steps solve the rest by coordinate descent on the centred weighted Gram matrix. Steps
need sums over the rows only, so the rows may be anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def profile(eta: np.ndarray, total: float) -> tuple[float, np.ndarray]:
    """The best intercept for given X w, and the means, which sum to the responses' sum."""
    top = eta.max()
    e = np.exp(eta - top)
    return math.log(total) - top - math.log(e.sum()), total * e / e.sum()


def objective(y, eta, w, lam: float, kappa: float) -> float:
    with np.errstate(over="ignore"):
        mu = np.exp(eta)
    return float((mu - y * eta).sum() + lam * np.abs(w).sum() + kappa / 2 * (w @ w))


def kkt(x, y, mu, w, lam: float, kappa: float) -> float:
    """Largest violation of the optimality conditions, per row."""
    worst = abs(float((mu - y).sum()))
    if len(w):
        worst = max(worst, violation(x.T @ (mu - y) + kappa * w, w, lam))
    return worst / len(y)


@dataclass
class Fit:
    b: float
    w: np.ndarray
    mu: np.ndarray
    value: float
    kkt: float


@dataclass
class Moments:
    """What a step needs of the rows at coefficients w: the best intercept, sum(mu - y eta), X'mu, X'y and X' diag(mu) X."""

    b: float
    loss: float
    mean: np.ndarray
    xy: np.ndarray
    gram: np.ndarray


def newton(at, total: float, n: int, w: np.ndarray, lam: float, kappa: float, tol: float = 1e-9, rounds: int = 200) -> tuple[np.ndarray, Moments, float, float]:
    """(w, moments, objective, KKT violation) by proximal Newton steps. at(w) gives Moments, wherever the rows are; it is
    called once a step, but for steps that are halved."""

    def value_of(w, m):
        return m.loss + lam * float(np.abs(w).sum()) + kappa / 2 * float(w @ w)

    m = at(w)
    value = value_of(w, m)
    worst = violation(m.mean - m.xy + kappa * w, w, lam) / n
    for _ in range(rounds):
        if worst <= tol or not len(w):
            break
        gram = m.gram - np.outer(m.mean, m.mean) / total + kappa * np.eye(len(w))
        g = m.mean - m.xy + kappa * w
        new, r = w.copy(), g.copy()  # r: gradient of the quadratic model at new
        for _ in range(500):
            moved = 0.0
            for j in np.flatnonzero((new != 0) | (np.abs(r) > lam * (1 - 1e-12))):
                z = gram[j, j] * new[j] - r[j]
                value_j = np.sign(z) * max(abs(z) - lam, 0.0) / gram[j, j]
                if d := value_j - new[j]:
                    new[j] = value_j
                    r += gram[:, j] * d
                    moved = max(moved, abs(d) * math.sqrt(gram[j, j]))
            if moved < 1e-11:
                break
        step, direction = 1.0, new - w
        if not np.abs(direction).max():
            break
        slack = 1e-14 * max(abs(value), abs(m.loss), total)  # round-off of the two sums
        for _ in range(40):
            trial = w + step * direction if step < 1 else new
            m2 = at(trial)
            value2 = value_of(trial, m2)
            if value2 <= value + slack:
                break
            step /= 2
        else:
            break
        worst2 = violation(m2.mean - m2.xy + kappa * trial, trial, lam) / n
        if value2 >= value - slack and worst2 >= worst:  # within round-off, and no better
            break
        w, m, value, worst = trial, m2, value2, worst2
    return w, m, value, worst


def violation(g: np.ndarray, w: np.ndarray, lam: float) -> float:
    """Largest violation of the optimality conditions, given the smooth part's gradient."""
    return float(np.where(w == 0, np.maximum(np.abs(g) - lam, 0), np.abs(g + lam * np.sign(w))).max()) if len(w) else 0.0


def positive(total: float, least: float) -> None:
    """An error unless responses of this sum and least value can be fitted."""
    if not (total > 0 and math.isfinite(total) and least >= 0):
        raise ValueError("responses must be finite, not negative, with a positive sum")


def solve(x: np.ndarray, y: np.ndarray, lam: float, kappa: float, warm: np.ndarray | None = None, tol: float = 1e-9, rounds: int = 200) -> Fit:
    """x is n by m, 0/1; y needs a positive sum."""
    total, xy = float(y.sum()), x.T @ y
    positive(total, float(y.min()) if len(y) else 0.0)
    w = np.zeros(x.shape[1]) if warm is None else np.array(warm, float)

    def at(w):
        z = x @ w
        b, mu = profile(z, total)
        return Moments(b, float((mu - y * (z + b)).sum()), x.T @ mu, xy, x.T @ (x * mu[:, None]))

    w, m, _, _ = newton(at, total, len(y), w, lam, kappa, tol, rounds)
    z = x @ w
    b, mu = profile(z, total)
    return Fit(b, w, mu, objective(y, z + b, w, lam, kappa), kkt(x, y, mu, w, lam, kappa))


def feasible(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """alpha = y - mu with the round-off of its sum taken by the row of the largest mean."""
    a = y - mu
    a[int(np.argmax(mu))] -= a.sum()
    return a


def dual(y: np.ndarray, alpha: np.ndarray, penalty: float) -> float:
    """Dual value for a conjugate penalty over the whole dictionary."""
    t = y - alpha
    if (t < -1e-12).any() or abs(alpha.sum()) > 1e-8 * max(1.0, y.sum()):
        return -math.inf
    t = np.maximum(t, 0)
    return float(-(np.where(t > 0, t * np.log(np.where(t > 0, t, 1)), 0) - t).sum() - penalty)


def radius(y: np.ndarray, alpha: np.ndarray, gap: float) -> float:
    """Radius of a ball around alpha that holds the dual optimum."""
    return radius_of(float(y.sum()), max(0.0, float((y - alpha).max())), gap)


def radius_of(total: float, most: float, gap: float) -> float:
    """radius() from the responses' sum and the largest y - alpha."""
    gamma = min(total, most + gap + math.sqrt(gap * (gap + 2 * most)))
    return math.sqrt(2 * gamma * gap)


def best_scale(y: np.ndarray, alpha: np.ndarray, violators: np.ndarray, lam: float, kappa: float) -> tuple[float, float]:
    """(s, dual) for s in [0, 1] that maximises the dual along s * alpha; violators are the correlations above lam."""

    def value(s: float) -> float:
        return dual(y, s * alpha, float((np.maximum(s * np.abs(violators) - lam, 0) ** 2).sum() / (2 * kappa)))

    lo, hi, ratio = 0.0, 1.0, (math.sqrt(5) - 1) / 2
    a, b = hi - ratio, lo + ratio
    fa, fb = value(a), value(b)
    for _ in range(80):
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = value(b)
        else:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = value(a)
    top = float(np.abs(violators).max()) if len(violators) else lam
    ends = [0.0, 1.0, min(1.0, lam / top) if top else 1.0, (lo + hi) / 2]
    return max(((s, value(s)) for s in ends), key=lambda p: p[1])


def scaled_dual(total_at, violators: np.ndarray, lam: float, kappa: float, enough: float = math.inf) -> tuple[float, float]:
    """best_scale() where the rows are elsewhere: total_at(list of s) gives the sums of t log t - t, t = y - s alpha, in one
    pass over the rows. The search ends as soon as a value reaches `enough`."""
    over = np.abs(violators)

    def values(scales: list[float]) -> list[tuple[float, float]]:
        sums = total_at(scales)
        return [(s, -float(f) - float((np.maximum(s * over - lam, 0) ** 2).sum() / (2 * kappa))) for s, f in zip(scales, sums, strict=True)]

    top = float(over.max()) if len(over) else lam
    tried = dict(values(sorted({0.0, 1.0, min(1.0, lam / top) if top else 1.0})))
    for _ in range(8):
        best = max(tried, key=tried.get)
        if tried[best] >= enough:
            break
        lo, hi = max([s for s in tried if s < best], default=best), min([s for s in tried if s > best], default=best)
        fresh = sorted(set(np.linspace(lo, hi, 18)[1:-1].tolist()) - set(tried))  # the dual is concave: the best is next to the best so far
        if hi - lo < 1e-12 or not fresh:
            break
        tried |= dict(values(fresh))
    return max(tried.items(), key=lambda p: p[1])


def best_segment(y: np.ndarray, one: np.ndarray, two: np.ndarray, c1: np.ndarray, c2: np.ndarray, lam: float, kappa: float) -> tuple[float, float]:
    """(t, dual) for t in [0, 1] that maximises the dual along (1 - t) one + t two.

    c1 and c2 are the correlations of both ends for the patterns that exceed lam at either: between the ends no other can.
    """

    def value(t: float) -> float:
        over = np.maximum(np.abs((1 - t) * c1 + t * c2) - lam, 0)
        return dual(y, (1 - t) * one + t * two, float((over**2).sum() / (2 * kappa)))

    lo, hi = 0.0, 1.0
    for _ in range(100):  # the dual is concave along the segment
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        if value(a) < value(b):
            lo = a
        else:
            hi = b
    return max(((t, value(t)) for t in (0.0, 1.0, (lo + hi) / 2)), key=lambda p: p[1])


def fista(x: np.ndarray, y: np.ndarray, lam: float, kappa: float, rounds: int = 20_000, tol: float = 1e-9, clip: float = 20.0) -> Fit:
    """The same problem as solve() by accelerated proximal steps with backtracking; eta is clipped, as older runs did."""

    def loss(b: float, w: np.ndarray) -> tuple[float, np.ndarray]:
        eta = np.clip(b + x @ w, -clip, clip)
        mu = np.exp(eta)
        return float((mu - y * eta).sum()) + kappa / 2 * float(w @ w), mu

    b, w = math.log(max(float(y.mean()), 1e-12)), np.zeros(x.shape[1])
    ahead, momentum, size = (b, w), 1.0, 1.0 / max(1.0, float(y.sum()))
    for _ in range(rounds):
        f, mu = loss(*ahead)
        gb, gw = float((mu - y).sum()), x.T @ (mu - y) + kappa * ahead[1]
        while True:
            nb, nw = ahead[0] - size * gb, ahead[1] - size * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - size * lam, 0)
            db, dw = nb - ahead[0], nw - ahead[1]
            if loss(nb, nw)[0] <= f + gb * db + float(gw @ dw) + (db * db + float(dw @ dw)) / (2 * size) + 1e-10 * abs(f):
                break
            size /= 2
        if (db * ahead[0] + float(dw @ ahead[1])) and (nb - b) * (nb - ahead[0]) + float((nw - w) @ (nw - ahead[1])) < 0:
            momentum = 1.0  # the step turned back: start again without momentum
        grown = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / grown
        ahead = nb + pull * (nb - b), nw + pull * (nw - w)
        b, w, momentum, size = nb, nw, grown, size * 1.1
        if kkt(x, y, (mu := loss(b, w)[1]), w, lam, kappa) <= tol:
            break
    _, mu = loss(b, w)
    return Fit(b, w, mu, objective(y, b + x @ w, w, lam, kappa), kkt(x, y, mu, w, lam, kappa))


def poisson_glm(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Ridge Poisson regression: mean of half deviances plus alpha / 2 |w|^2, by damped Newton steps."""
    n, design = len(y), np.column_stack([np.ones(len(y)), x])
    w = np.zeros(design.shape[1])
    w[0] = math.log(max(y.mean(), 1e-9))
    pen = np.full(len(w), alpha)
    pen[0] = 0
    value = lambda w: float((np.exp(design @ w) - y * (design @ w)).mean() + (pen * w * w).sum() / 2)
    for _ in range(rounds):
        mu = np.exp(design @ w)
        g = design.T @ (mu - y) / n + pen * w
        if np.abs(g).max() < 1e-10:
            break
        d = np.linalg.solve(design.T @ (design * mu[:, None]) / n + np.diag(pen + 1e-12), g)
        step, now = 1.0, value(w)
        while step > 1e-8 and value(w - step * d) > now:
            step /= 2
        w = w - step * d
    return float(w[0]), w[1:]
