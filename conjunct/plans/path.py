"""Regularisation paths over a whole pattern dictionary.

The dictionary is enumerated once; each pattern's rows are written as lists of row numbers, in blocks of rows, and stay in
Spark. Nothing with an entry a row reaches the driver: a solver's step and a dual value are sums over the blocks, each of
which makes its part of the dual vector from the coefficients, and the driver holds the dictionary's itemsets and what has
the size of the working set. Lists of at most HELD entries are held by the driver all the same, to save the jobs. A point
counts as solved when the duality gap, taken over the unscreened dictionary, certifies it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from conjunct.operators import itemsets, scoring
from conjunct.plans import blocks, solver, splits
from conjunct.plans.blocks import Dual
from conjunct.plans.store import written
from conjunct.session import ship

#: Rows of a block at most.
BLOCK = 1 << 15
#: Entries of a block's lists on average, and flags of its items, at most: blocks have fewer rows where rows hold many patterns.
CELLS = 1 << 20
ITEMS = 1 << 24
#: Entries of all lists that the driver holds at most (32 MB); beyond, every sum is a job.
HELD = 1 << 23
#: Numbers in partial sums that come to the driver as they are; more are first added up in tasks.
PARTIAL = 1 << 23


@dataclass
class Config:
    kappa: float = 0.05
    top_k: int = 200
    max_rounds: int = 100
    gap_tol: float = 1e-7
    solver_tol: float = 1e-7
    screen: bool = True


def grid(points: int = 101) -> list[float]:
    """tau_k = 10 ** (-2 k / (points - 1))."""
    return [10 ** (-2 * k / (points - 1)) for k in range(points)] if points > 1 else [1.0]


@dataclass
class Point:
    tau: float
    lam: float
    b: float
    w: dict[tuple, float]
    objective: float
    gap: float
    kkt: float
    rounds: int
    converged: bool
    excluded: int = 0
    alpha: Dual | None = field(default=None, repr=False)  # a feasible dual vector, scaled to the best value


class Dictionary:
    """Patterns of a fitting subset: item_tid (tid, item) and response (tid, y)."""

    def __init__(self, item_tid: DataFrame, response: DataFrame, least: int, max_len: int, space: str = "closed"):
        self.spark: SparkSession = item_tid.sparkSession
        ship(self.spark)
        placed = written(splits.ordinal(response.select("tid", F.col("y").cast("double").alias("y")), "tid"), "placed")
        found, self.names = itemsets.encoded(item_tid, least)
        rows = written(placed.join(found, "tid", "left").select("place", "y", "items"), "rows")
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("least")).first()
        self.n, self.least = r["n"], r["least"] if r["n"] else 0.0
        levels = itemsets.levels(rows.select("items"), least, max_len + (space == "closed"), [], written)
        kept = itemsets.closed_of(levels, max_len) if space == "closed" else itemsets.reduce_union(levels[:max_len])
        kept = kept.select("itemset", "s").toArrow()  # their number follows the shape of rows, not how many there are
        self.patterns = sorted(tuple(p) for p in kept["itemset"].to_pylist())
        self.size, self.at = len(self.patterns), {p: k for k, p in enumerate(self.patterns)}
        entries = sum(kept["s"].to_pylist())
        width = max(1, min(BLOCK, self.n * CELLS // max(entries, 1), ITEMS // max(len(self.names), 1)))
        patterns = self.shared = self.spark.sparkContext.broadcast(self.patterns)

        def make(key, table):
            table = table.sort_by("place").combine_chunks()
            items, start = table["items"].combine_chunks(), int(key[0].as_py()) * width
            lengths = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return pa.Table.from_batches([blocks.block_of(key[0].as_py(), start, table["y"].to_numpy(), lengths, items.flatten().to_numpy(), patterns.value)])

        block = F.expr(f"place div {width}").alias("block")
        lists = rows.select(block, "place", "y", "items").groupBy("block").applyInArrow(make, blocks.SCHEMA)
        self.lists = written(lists, "lists")
        totals = self.lists.select("block", "total").toArrow().sort_by("block")["total"].to_pylist()
        self.total, self.cuts, self.whole = math.fsum(totals), len(totals), len(totals) <= 1
        self.mean = self.total / self.n if self.n else math.nan
        self.held = list(blocks.blocks(self.lists.orderBy("block").toArrow().to_batches())) if max(entries, self.n) <= HELD else None

    @property
    def y(self) -> np.ndarray:
        """The response by place, one entry a row: no part of a path needs it."""
        held = self.lists.select("start", "y").toArrow().sort_by("start")
        return np.frombuffer(b"".join(held["y"].to_pylist()), "<f8")

    def summed(self, part, merge) -> list[np.ndarray]:
        """merge() of part(block) over all blocks; a part is a list of arrays."""
        if self.held is not None:
            got = None
            for b in self.held:
                got = merge(got, part(b))
            return got

        def packed(k: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([[a.astype("<f8").tobytes() for a in arrays]], pa.list_(pa.binary()))], ["part", "arrays"])

        def unpacked(table) -> list[list[np.ndarray]]:
            return [[np.frombuffer(a, "<f8") for a in arrays] for arrays in table.sort_by("part")["arrays"].to_pylist()]

        def run(batches):
            got = None
            for b in blocks.blocks(batches):
                got = merge(got, part(b))
            if got is not None:
                yield packed(TaskContext.get().partitionId(), got)

        def more(key, table):
            return pa.Table.from_batches([packed(key[0].as_py(), functools.reduce(merge, unpacked(table), None))])

        schema = "part long, arrays array<binary>"
        parts = self.lists.mapInArrow(run, schema)
        if self.cuts * part.size > PARTIAL:
            parts = parts.groupBy(F.expr("part div 8").alias("group")).applyInArrow(more, schema)
        return functools.reduce(merge, unpacked(parts.toArrow()), None)

    def moments(self, patterns: list[tuple]):
        """w -> solver.Moments for a working set."""
        numbers = np.array([self.at[p] for p in patterns], np.int64)

        def at(w: np.ndarray) -> solver.Moments:
            (top, e), mean, xy, gram = self.summed(_Part(blocks.moments, numbers, w, size=len(w) ** 2), blocks.merged)
            b, f = math.log(self.total) - top - math.log(e), self.total / e
            return solver.Moments(b, self.total - b * self.total - float(w @ xy), f * mean, xy, f * gram.reshape(len(w), len(w)))

        return at

    def dual(self, b: float, patterns: list[tuple], w: np.ndarray) -> Dual:
        numbers = np.array([self.at[p] for p in patterns], np.int64)
        return Dual(b, numbers[w != 0], w[w != 0])

    def entropies(self, dual: Dual, scales: list[float]) -> list[np.ndarray]:
        """For each scale the sum of t log t - t and the largest t, t = y - scale (y - mu)."""
        return self.summed(_Part(blocks.entropies, dual, scales), blocks.merged_entropies)

    def scored(self, **vectors: Dual | np.ndarray) -> DataFrame:
        """(itemset, s, sums of each vector and of its positive and negative parts) over the whole dictionary."""
        shared = self.spark.sparkContext.broadcast({v: x if isinstance(x, Dual) else np.asarray(x, float) for v, x in vectors.items()})
        names, patterns = [f"{v}{part}" for v in vectors for part in ("", "_pos", "_neg")], self.shared

        def run(batches):
            held = patterns.value
            for b in blocks.blocks(batches):
                if not len(b.numbers):
                    continue
                starts = np.concatenate([[0], b.ends[:-1]])
                out = [pa.array([held[k] for k in b.numbers.tolist()], pa.list_(pa.int32())), pa.array(b.ends - starts, pa.int64())]
                for x in shared.value.values():
                    own = b.alpha(x)[b.rows]
                    out += [pa.array(np.add.reduceat(y, starts), pa.float64()) for y in (own, np.maximum(own, 0), np.maximum(-own, 0))]
                yield pa.RecordBatch.from_arrays(out, ["itemset", "s", *names])

        schema = StructType().add("itemset", ArrayType(IntegerType())).add("s", LongType())
        for c in names:
            schema = schema.add(c, DoubleType())
        found = self.lists.mapInArrow(run, schema)
        return found if self.whole else found.groupBy("itemset").agg(*[F.sum(c).alias(c) for c in ("s", *names)])

    def above(self, lam: float, **vectors: Dual | np.ndarray) -> tuple[list[tuple], dict[str, np.ndarray]]:
        """Patterns that some vector's correlation with exceeds lam, and these correlations."""
        over = F.greatest(*[F.abs(v) for v in vectors], F.lit(0.0)) > lam
        got = self.scored(**vectors).filter(over).select("itemset", *vectors).toArrow()
        return [tuple(p) for p in got["itemset"].to_pylist()], {v: got[v].to_numpy() for v in vectors}

    def lambda_max(self) -> tuple[float, tuple | None]:
        start = Dual(math.log(self.mean) if self.mean > 0 else -math.inf)
        best = self.scored(alpha=start).select(F.abs("alpha").alias("c"), "itemset").orderBy(F.desc(F.round("c", 9)), "itemset").first()
        return (float(best["c"]), self.named([tuple(best["itemset"])])[0]) if best else (0.0, None)

    def named(self, patterns: list[tuple]) -> list[tuple]:
        return [tuple(self.names[i] for i in p) for p in patterns]

    def numbered(self, patterns: list[tuple]) -> list[tuple]:
        at = {x: i for i, x in enumerate(self.names)}
        return [tuple(at[x] for x in p) for p in patterns]


class _Part:
    """A sum's part of one block: f(block, *given). size: entries of the largest array that comes of it."""

    def __init__(self, f, *given, size: int = 1):
        self.f, self.given, self.size = f, given, size

    def __call__(self, b: blocks.Block) -> list[np.ndarray]:
        return self.f(b, *self.given)


def fingerprint(y: np.ndarray, config: Config) -> str:
    return hashlib.sha256(json.dumps([asdict(config), hashlib.sha256(y.tobytes()).hexdigest()], sort_keys=True).encode()).hexdigest()


def fit_point(d: Dictionary, lam: float, config: Config, lambda_max: float, warm: Point | None = None, tau: float | None = None) -> Point:
    tau = lam / lambda_max if tau is None and lambda_max else tau or 1.0
    n = d.n
    if warm is None and lam >= lambda_max:
        b = math.log(d.mean)
        return Point(tau, lam, b, {}, d.total - b * d.total if d.n else 0.0, 0.0, 0.0, 0, True, d.size, Dual(b))
    solver.positive(d.total, d.least)
    have: list[tuple] = d.numbered([p for p, v in warm.w.items() if v]) if warm else []
    start = np.array([v for v in warm.w.values() if v]) if warm else np.zeros(0)
    best = (-math.inf, None)
    for k in range(1, config.max_rounds + 1):
        w, m, primal, kkt = solver.newton(d.moments(have), d.total, n, start, lam, config.kappa, tol=config.solver_tol / 100)
        dual = d.dual(m.b, have, w)
        patterns, c = d.above(lam * (1 + 1e-12), alpha=dual)
        enough = primal - config.gap_tol * n / 100
        s, value = solver.scaled_dual(lambda scales: d.entropies(dual, scales)[0], c["alpha"], lam, config.kappa, enough)  # noqa: B023  called at once
        best = max(best, (value, k), key=lambda p: p[0])
        if best[1] == k:
            reference = replace(dual, scale=s)
        gap = max(0.0, primal - best[0])
        done = gap / n <= config.gap_tol and kkt <= config.solver_tol
        known = set(have)
        order = sorted((-round(abs(v), 9), p) for p, v in zip(patterns, c["alpha"].tolist(), strict=True) if p not in known)
        fresh = [] if done else [p for _, p in order[: config.top_k]]
        if done or not fresh:
            break
        have += fresh
        start = np.concatenate([w, np.zeros(len(fresh))])
    point = Point(tau, lam, m.b, dict(zip(d.named(have), w.tolist(), strict=True)), primal, gap, kkt, k, done, 0, reference)
    if config.screen:
        point.excluded = d.size - arms(d, point, warm, config, ["vu_two" if warm is not None else "vu_single"])[0][1]
    return point


#: Arms of the screened search: (mode, references).
ARMS = {"none": ("none", 1), "v_only": ("vprune", 1), "u_only": ("uscreen", 1), "vu_single": ("both", 1), "vu_two": ("both", 2)}


def arms(d: Dictionary, point: Point, previous: Point | None, config: Config, names: list[str]) -> list[tuple[str, int]]:
    """How many patterns each arm keeps at a point: balls around the point's own dual vector and, for two references, around
    that of the point before, each as large as its own duality gap at this lambda says."""
    vectors = {"alpha": point.alpha}
    if previous is not None and previous.alpha is not None:
        vectors["before"] = previous.alpha
    _, c = d.above(point.lam, **vectors)
    refs = {}
    for v, a in vectors.items():
        (total,), (most,) = d.entropies(a, [a.scale])
        value = -float(total) - float((np.maximum(np.abs(c[v]) - point.lam, 0) ** 2).sum() / (2 * config.kappa))
        refs[v] = solver.radius_of(d.total, float(most), max(0.0, point.objective - value))
    scored = d.scored(**vectors)
    out = []
    for name in names:
        mode, balls = ARMS[name]
        second = None
        if balls == 2 and "before" in refs and math.isfinite(refs["before"]):
            second = ("before", refs["before"], float(d.summed(_Part(blocks.apart, vectors["alpha"], vectors["before"]), blocks.added)[0][0]))
        out.append((name, scoring.screened(scored, point.lam, refs["alpha"], d.n, mode=mode, second=second).count()))
    return out


def ablation(d: Dictionary, points: list[Point], config: Config) -> DataFrame:
    """(point, arm, kept, eligible) for every arm of the search at each point of a path."""
    rows = []
    for k, p in enumerate(points):
        if p.rounds:
            rows += [(k, name, kept, d.size) for name, kept in arms(d, p, points[k - 1] if k else None, config, list(ARMS))]
    return d.spark.createDataFrame(rows, "point int, arm string, kept long, eligible long")


def fit_path(d: Dictionary, taus: list[float], config: Config | None = None) -> list[Point]:
    """Warm-started points; a point that didn't converge never seeds the next."""
    config, out = config or Config(), []
    top, _ = d.lambda_max()
    previous = None
    for tau in taus:
        point = fit_point(d, tau * top, config, top, previous, tau)
        out.append(point)
        previous = point if point.converged and point.w else previous
    return out


def fit_cv(item_tid: DataFrame, response: DataFrame, folds: DataFrame, taus: list[float], least, max_len: int, config: Config | None = None, score: str = "nll") -> tuple[float, list[tuple]]:
    """(tau, [(fold, tau, score)]): the tau of least mean score over the folds (tid, fold), the largest of equal ones.

    Each fold's rows are scored by the path of the other rows, whose own lambda_max sets its scale. score is nll (mean of
    mu - y eta) or rmse; least(n) gives the support for n rows.
    """
    found = []
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        fit, held = (folds.filter(F.col("fold") == fold), folds.filter(F.col("fold") != fold))[::-1]
        train = response.join(fit.select("tid"), "tid", "left_semi")
        d = Dictionary(item_tid.join(fit.select("tid"), "tid", "left_semi"), train, least(train.count()), max_len)
        tests = response.join(held.select("tid"), "tid", "left_semi")
        tx = item_tid.join(held.select("tid"), "tid", "left_semi")
        for p in fit_path(d, taus, config):
            w = d.spark.createDataFrame([(list(q), v) for q, v in p.w.items() if v], f"itemset array<{item_tid.schema['item'].dataType.simpleString()}>, w double")
            both = tests.join(predict(w, p.b, tx, tests), "tid")
            value = F.avg(F.col("mu") - F.col("y") * F.ln("mu")) if score == "nll" else F.sqrt(F.avg((F.col("y") - F.col("mu")) ** 2))
            found.append((fold, p.tau, float(both.agg(value).first()[0])))
    means = {t: float(np.mean([v for _, u, v in found if u == t])) for t in taus}
    return min(taus, key=lambda t: (means[t], -t)), found


def audit(d: Dictionary, point: Point, kappa: float) -> dict[str, float]:
    """Gap and KKT of a point recomputed from its coefficients over the whole dictionary, without any screening."""
    patterns, w = d.numbered(list(point.w)), np.array(list(point.w.values()))
    m = d.moments(patterns)(w)
    dual = d.dual(m.b, patterns, w)
    outside, c = d.above(point.lam, alpha=dual)
    _, value = solver.scaled_dual(lambda scales: d.entropies(dual, scales)[0], c["alpha"], point.lam, kappa)
    known = set(patterns)
    worst = max([abs(v) - point.lam for p, v in zip(outside, c["alpha"].tolist(), strict=True) if p not in known], default=0.0)
    kkt = max(solver.violation(m.mean - m.xy + kappa * w, w, point.lam), worst) / d.n
    objective = m.loss + point.lam * float(np.abs(w).sum()) + kappa / 2 * float(w @ w)
    return {"gap": max(0.0, objective - value) / d.n, "kkt": kkt}


def predict(point_w: DataFrame, b: float, item_tid: DataFrame, tids: DataFrame) -> DataFrame:
    """(tid, mu): exp of the intercept and the coefficients (itemset, w) of contained patterns."""
    hits = itemsets.contain_join(point_w.select("itemset"), item_tid).join(point_w, "itemset").groupBy("tid").agg(F.sum("w").alias("z"))
    return tids.select("tid").join(hits, "tid", "left").select("tid", F.exp(F.lit(b) + F.coalesce("z", F.lit(0.0))).alias("mu"))


def package(point: Point) -> dict:
    """A point as a record that JSON can hold: coefficients that aren't 0, and the certificate."""
    return {"tau": point.tau, "lam": point.lam, "b": point.b, "patterns": [list(p) for p, v in point.w.items() if v], "w": [v for v in point.w.values() if v], "gap": point.gap, "kkt": point.kkt, "converged": point.converged}


def as_frame(spark: SparkSession, points: list[Point]) -> DataFrame:
    """One row a point."""
    rows = [(k, float(p.tau), float(p.lam), float(p.b), sum(v != 0 for v in p.w.values()), float(p.objective), float(p.gap), float(p.kkt), p.rounds, bool(p.converged), int(p.excluded)) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "point int, tau double, lam double, b double, active int, objective double, gap double, kkt double, rounds int, converged boolean, excluded long")
