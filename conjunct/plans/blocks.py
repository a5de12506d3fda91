"""Blocks of rows with what a pattern dictionary makes of them, and the sums over rows that a path needs.

A block is one row of a table: the responses of a range of rows and, for each pattern, which of these rows hold it. A dual
vector has an entry a row, so none is kept: a Dual says how to make it, and each block makes its own part. What leaves a
block has the size of the working set or of the dictionary, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SCHEMA = "block long, start long, total double, y binary, numbers binary, ends binary, rows binary"


@dataclass
class Dual:
    """alpha = scale * (y - exp(b + X w)), with X w over the patterns of these numbers."""

    b: float
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0


def block_of(number: int, start: int, y: np.ndarray, lengths: np.ndarray, flat: np.ndarray, patterns: list[tuple]) -> pa.RecordBatch:
    """The row of a block whose rows have the items `flat`, `lengths` of them each; patterns are sorted."""
    n = len(y)
    has = np.zeros((int(flat.max()) + 1 if len(flat) else 0, n), bool)
    has[flat, np.repeat(np.arange(n), lengths)] = True
    stack: list[tuple[tuple, np.ndarray]] = [((), np.ones(n, bool))]  # prefixes of the pattern at hand and who holds them
    numbers, found = [], []
    for k, p in enumerate(patterns):
        while stack[-1][0] != p[: len(stack) - 1]:
            stack.pop()
        for i in p[len(stack) - 1 :]:
            stack.append((p[: len(stack)], stack[-1][1] & has[i] if i < len(has) else np.zeros(n, bool)))
        if len(rows := np.flatnonzero(stack[-1][1])):
            numbers.append(k)
            found.append(rows.astype("<i4"))
    ends = np.cumsum([len(r) for r in found], dtype="<i8")
    rows = np.concatenate(found) if found else np.zeros(0, "<i4")
    values = [number, start, float(y.sum()), y.astype("<f8").tobytes(), np.asarray(numbers, "<i4").tobytes(), ends.tobytes(), rows.tobytes()]
    types = [pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class Block:
    def __init__(self, start: int, y, numbers, ends, rows):
        self.start, self.y, self.numbers = start, np.frombuffer(y, "<f8"), np.frombuffer(numbers, "<i4")
        self.ends, self.rows = np.frombuffer(ends, "<i8"), np.frombuffer(rows, "<i4")
        self.n = len(self.y)

    def lists(self, numbers: np.ndarray):
        """(k, rows) for those of the patterns that occur here; k is a pattern's place in numbers."""
        at = np.searchsorted(self.numbers, numbers)
        for k, (a, x) in enumerate(zip(at.tolist(), numbers.tolist(), strict=True)):
            if a < len(self.numbers) and self.numbers[a] == x:
                yield k, self.rows[self.ends[a - 1] if a else 0 : self.ends[a]]

    def eta(self, numbers: np.ndarray, w: np.ndarray) -> np.ndarray:
        """X w"""
        z = np.zeros(self.n)
        for k, rows in self.lists(numbers):
            if w[k]:
                z[rows] += w[k]
        return z

    def mu(self, d: Dual) -> np.ndarray:
        return np.exp(d.b + self.eta(d.numbers, d.w))

    def alpha(self, d: Dual | np.ndarray) -> np.ndarray:
        return d.scale * (self.y - self.mu(d)) if isinstance(d, Dual) else d[self.start : self.start + self.n]


def blocks(batches):
    for b in batches:
        start, *parts = (b.column(i) for i in (1, 3, 4, 5, 6))
        for i in range(b.num_rows):
            yield Block(start[i].as_py(), *[p[i].as_buffer() for p in parts])


def moments(b: Block, numbers: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """[top, sum e], X'e, X'y, X' diag(e) X with e = exp(X w - top); merged() adds such lists up."""
    z = b.eta(numbers, w)
    top, p = float(z.max()), len(numbers)
    e = np.exp(z - top)
    mean, xy, gram = np.zeros(p), np.zeros(p), np.zeros((p, p))
    lists = list(b.lists(numbers))
    for k, rows in lists:
        mean[k], xy[k] = e[rows].sum(), b.y[rows].sum()
    if lists:
        step, root = max(1, (1 << 20) // len(lists)), np.sqrt(e)
        own = np.array([k for k, _ in lists])
        part = np.zeros((len(lists), len(lists)))
        for at in range(0, b.n, step):
            x = np.zeros((len(lists), min(step, b.n - at)))
            for k, (_, rows) in enumerate(lists):
                i, j = np.searchsorted(rows, (at, at + step))
                x[k, rows[i:j] - at] = root[rows[i:j]]
            part += x @ x.T
        gram[np.ix_(own, own)] = part
    return [np.array([top, e.sum()]), mean, xy, gram.ravel()]


def merged(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
    if a is None:
        return b
    if a[0][0] < b[0][0]:
        a, b = b, a
    f = np.exp(b[0][0] - a[0][0])
    return [np.array([a[0][0], a[0][1] + f * b[0][1]]), a[1] + f * b[1], a[2] + b[2], a[3] + f * b[3]]


def entropies(b: Block, d: Dual, scales: list[float]) -> list[np.ndarray]:
    """For each scale the sum of t log t - t and the largest t, t = y - scale (y - mu), which is never negative for scales in [0, 1]."""
    mu, out = b.mu(d), []
    for s in scales:
        t = np.maximum((1 - s) * b.y + s * mu, 0)
        out.append(((t * np.log(np.where(t > 0, t, 1))).sum() - t.sum(), t.max()))
    return [np.array([x for x, _ in out]), np.array([x for _, x in out])]


def merged_entropies(a, b):
    return b if a is None else [a[0] + b[0], np.maximum(a[1], b[1])]


def apart(b: Block, one: Dual, two: Dual) -> list[np.ndarray]:
    """The squared distance of two dual vectors."""
    return [np.array([((b.alpha(one) - b.alpha(two)) ** 2).sum()])]


def added(a, b):
    return b if a is None else [x + y for x, y in zip(a, b, strict=True)]
