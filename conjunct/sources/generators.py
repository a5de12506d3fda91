"""Seeded synthetic transactions with planted conjunctions and Poisson responses (numpy on the driver).

The draws follow the study's recipes stream by stream, so a registered seed gives the registered rows: one stream each for
the truths' items, the other items, the counts, the items' permutation and the order of lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the published study.
COEFFICIENTS = [0.9, -0.8, 0.75, 1.1, -0.85, 0.95, 0.8, -1.0, 0.9, -0.8, 0.75, 1.1]
ROWS, ITEMS, SIGNAL, NOISE, BASELINE = 2000, 64, 0.65, 0.20, 30.0
ENTROPY, NOISE_COLUMNS, TRAIN = 202609244, 96, 0.7
LEGACY_PATTERNS = [(3, 7, 15, 22), (10, 11, 12, 19), (25, 26, 37, 48), (1, 5, 9, 17), (2, 14, 31, 45), (6, 18, 33, 55), (4, 21, 38, 52), (8, 16, 29, 43)]
LEGACY_PROBABILITIES = [0.35, 0.30, 0.38, 0.28, 0.32, 0.25, 0.30, 0.27]
LEGACY_WEIGHTS = {
    "small": [0.55, -0.50, 0.50, 0.65, -0.50, 0.55, 0.50, -0.55],
    "medium": [0.90, -0.80, 0.75, 1.10, -0.85, 0.95, 0.80, -1.00],
    "large": [1.35, -1.20, 1.125, 1.65, -1.275, 1.425, 1.20, -1.50],
}
LEGACY_ITEMS, LEGACY_OWN_NOISE, LEGACY_NOISE = 150, 0.10, 0.05


@dataclass
class Planted:
    transactions: list[list[int]]
    y: np.ndarray
    truths: list[list[int]]
    weights: np.ndarray
    mean: np.ndarray

    def role(self, row: int) -> str:
        return "train" if row < int(TRAIN * len(self.y)) else "test"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(tid, items, y, role)"""
        rows = [(i, t, float(v), self.role(i)) for i, (t, v) in enumerate(zip(self.transactions, self.y, strict=True))]
        return spark.createDataFrame(rows, "tid long, items array<int>, y double, role string")


def streams(seed: int) -> list[np.random.Generator]:
    """Truths' items, other items, counts, permutation, order of lengths."""
    return [np.random.default_rng(s) for s in np.random.SeedSequence([seed, ENTROPY]).spawn(5)]


def planted(lengths: np.ndarray, probabilities: np.ndarray, seed: int, rows: int = ROWS, items: int = ITEMS) -> Planted:
    """Disjoint truths of given lengths, whose items are present with the truth's own probability."""
    width = int(np.sum(lengths))
    if width > items or items > NOISE_COLUMNS:
        raise ValueError("the truths need more items than there are")
    own, other, counts, order, _ = streams(seed)
    present = np.hstack([own.random((rows, width)) < np.repeat(probabilities, lengths), other.random((rows, NOISE_COLUMNS))[:, : items - width] < NOISE])
    ends = np.cumsum(lengths)
    spans = [slice(int(e - n), int(e)) for e, n in zip(ends, lengths)]
    weights = np.array(COEFFICIENTS[: len(lengths)])
    mean = np.exp(np.log(BASELINE) + np.stack([present[:, s].all(axis=1) for s in spans], axis=1) @ weights)
    y = counts.poisson(mean)
    names = order.permutation(items)
    return Planted([np.sort(names[r]).tolist() for r in present], y, [np.sort(names[s]).tolist() for s in spans], weights, mean)


def generate_count(truths: int, seed: int, rows: int = ROWS) -> Planted:
    """Four-item conjunctions."""
    return planted(np.full(truths, 4), np.full(truths, SIGNAL), seed, rows)


def generate_length(longest: int, seed: int, rows: int = ROWS) -> Planted:
    """Four conjunctions of lengths longest - 3 .. longest, in shuffled order, each true as often as one of four items."""
    lengths = np.arange(longest - 3, longest + 1)
    streams(seed)[4].shuffle(lengths)
    return planted(lengths, SIGNAL ** (4 / lengths), seed, rows)


def generate_mixed(regime: str, truths: int, seed: int, rows: int = ROWS) -> Planted:
    """Regimes fixed4, mixed_natural (items as likely as ever) and mixed_equal_support (truths as likely as ever); 4 or 8 truths."""
    if regime not in ("fixed4", "mixed_natural", "mixed_equal_support") or truths not in (4, 8):
        raise ValueError("unknown regime or number of truths")
    if regime == "fixed4":
        lengths = np.full(truths, 4)
    else:
        lengths = np.tile([2, 3, 4, 5], truths // 4)
        streams(seed)[4].shuffle(lengths)
    return planted(lengths, SIGNAL ** (4 / lengths) if regime == "mixed_equal_support" else np.full(truths, SIGNAL), seed, rows)


def generate_basic(rows: int = 300, items: int = 50, length: float = 7, seed: int = 1) -> list[list[int]]:
    """Baskets of Poisson sizes, one item at least, of items drawn alike."""
    rng = np.random.default_rng(seed)
    sizes = lambda: min(max(1, int(rng.poisson(length))), items)
    return [np.sort(rng.choice(items, sizes(), replace=False)).tolist() for _ in range(rows)]


def generate_planted_baskets(patterns: list[tuple], probabilities: list[float], rows: int = 300, items: int = 60, present: float = 0.10, seed: int = 0) -> list[list[int]]:
    """Baskets of independent items into which whole patterns are put with probabilities of their own."""
    if len(patterns) != len(probabilities):
        raise ValueError("each pattern needs a probability")
    rng, out = np.random.default_rng(seed), []
    for _ in range(rows):
        held = rng.random(items) < present
        for p, share in zip(patterns, probabilities):
            held[list(p)] |= rng.random() < share
        out.append(np.flatnonzero(held).tolist())
    return out


def poisson_labels(transactions: list[list[int]], patterns: list[tuple], weights, intercept: float = -0.8, seed: int = 2, clip: float | None = None) -> np.ndarray:
    """Counts whose log means are the intercept and the weights of the patterns that a transaction has."""
    sets = [set(t) for t in transactions]
    eta = intercept + np.array([[set(p) <= t for p in patterns] for t in sets], float).reshape(len(sets), len(patterns)) @ np.asarray(weights, float)
    eta = eta if clip is None else np.clip(eta, -clip, clip)
    return np.random.default_rng(seed).poisson(np.exp(eta)).astype(float)


def generate_legacy(rows: int, seed: int, size: str = "medium") -> tuple[list[list[int]], np.ndarray]:
    """Eight four-item patterns among 150 items, with noise of both kinds; responses by the named weights."""
    rng, own = np.random.default_rng(seed), sorted(i for p in LEGACY_PATTERNS for i in p)
    others = [i for i in range(LEGACY_ITEMS) if i not in set(own)]
    out = []
    for _ in range(rows):
        held = {i for p, share in zip(LEGACY_PATTERNS, LEGACY_PROBABILITIES) if rng.random() < share for i in p}
        held |= {i for i in own if i not in held and rng.random() < LEGACY_OWN_NOISE}
        held |= {i for i in others if rng.random() < LEGACY_NOISE}
        out.append(sorted(held))
    return out, poisson_labels(out, LEGACY_PATTERNS, LEGACY_WEIGHTS[size], -0.2, seed, 5.0)
