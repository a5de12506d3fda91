"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows of its hash and of the hash of its first letters, so that inflected forms of a
stem share a part. Filters of several widths slide over all words of a text; each filter's largest response goes to a
logistic layer. Since a response is a sum over the filter's places, a trained filter is a table by hash row and place,
and scoring is a sum of look-ups over whole texts. The score is calibrated to a probability; thresholds for the decision
are chosen for each language.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conjunct.llm.shared import boxed, unboxed, utf8, whole_text_batches
from conjunct.llm.units import CACHED_LENGTH, claim, held, runs, slices

ROWS, STEM, WIDTHS, FILTERS, SIZE = 1 << 15, 4, (1, 2, 3), 8, 8
#: Words that are gone through at once.
BLOCK = 1 << 17
#: Row of the gap between texts: its embedding is zero and stays so.
GAP = 0
_EDGE = ".,;:!?\"'()[]{}<>*#$%&@-_/\\|=+~`^"


class Words(dict):
    """word -> row of its hash and row of its stem's hash, in one number; emptied when full."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE)
        both = (1 + zlib.crc32(bare.encode()) % (ROWS - 1)) << 20 | (1 + zlib.crc32(b"^" + bare[:STEM].encode()) % (ROWS - 1)) if bare else 0
        if len(self) > 400_000:
            self.clear()
        if len(word) <= CACHED_LENGTH:
            self[word] = both
        return both


_WORDS = Words()
held("toxicity", _WORDS)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words of all texts with a gap of the widest filter after each text, and where each text starts."""
    gap = np.full(max(WIDTHS), GAP, np.int64)
    parts, starts, at = [], [], 0
    for x in texts:
        starts.append(at)
        for part in runs(x or ""):
            words = part.lower().split()
            parts.append(np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)))
            at += len(words)
        parts.append(gap)
        at += len(gap)
    both = np.concatenate(parts) if parts else gap[:0]
    return (both >> 20).astype(np.int32), (both & ((1 << 20) - 1)).astype(np.int32), np.asarray(starts, np.int64)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embedding @ f[o]).astype(np.float32) for o in range(len(f))] for f in self.filters]

    def raw(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray, tables) -> np.ndarray:
        """The logistic layer's sum for encoded texts; the filters slide over BLOCK places at a time."""
        best = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for k, (width, places) in enumerate(zip(WIDTHS, tables, strict=True)):
            own, last = best[:, k * FILTERS : (k + 1) * FILTERS], len(a) - width + 1
            for at in range(0, last, BLOCK):
                stop = min(last, at + BLOCK)
                z = np.zeros((stop - at, FILTERS), np.float32)
                for o, t in enumerate(places):
                    z += t[a[at + o : stop + o]]
                    z += t[b[at + o : stop + o]]
                i, j = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, stop)
                own[i:j] = np.maximum(own[i:j], np.maximum.reduceat(z, np.maximum(starts[i:j] - at, 0), axis=0))
        return np.maximum(best + self.bias, 0) @ self.out + self.base

    def scores(self, texts: list[str | None], tables=None) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        tables = tables or self.tables()
        found = [self.raw(*encode(texts[i:j]), tables) for i, j in slices(texts)]
        return self.calibrated(np.concatenate(found) if found else np.zeros(0))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _pooled(a, b, starts, stops, model: Model):
    """Largest response of each filter in each text, and where."""
    e = model.embedding
    x = e[a] + e[b]
    best, where = [], []
    for width, f in zip(WIDTHS, model.filters, strict=True):
        z = sum(x[o : len(x) - width + 1 + o] @ f[o] for o in range(width))
        at = np.stack([s + z[s : max(s + 1, t - width + 1)].argmax(axis=0) for s, t in zip(starts, stops, strict=True)])
        where.append(at)
        best.append(np.take_along_axis(z, at, axis=0))
    return x, np.concatenate(best, axis=1), where


def fit(texts: list[str | None], labels: list[int], langs: list[str], **how) -> Model:
    """fitted() for texts that are at hand."""
    return fitted(*encode(texts), labels, langs, **how)


def fitted(a: np.ndarray, b: np.ndarray, starts: np.ndarray, labels, langs: list[str], epochs: int = 6, least_steps: int = 300, rate: float = 0.01, batch: int = 64, drop: float = 0.2, seed: int = 7) -> Model:
    """A model of labelled texts, encoded: four fifths train it, the last fifth calibrates scores and thresholds.

    Small samples are gone through until least_steps are made; a share `drop` of the words lose their own row or their
    stem's in each step, so that neither is relied on alone. A step's texts are gone through about BLOCK words at a time.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((ROWS, SIZE)), [], np.zeros(0), np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    order = rng.permutation(len(y))
    hold = order[: max(1, len(y) // 5)]
    train = order[len(hold) :] if len(order) > len(hold) else order
    n = len(WIDTHS) * FILTERS
    model = Model(
        rng.normal(0, 0.1, (ROWS, SIZE)).astype(np.float32),
        [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n, np.float32),
        rng.normal(0, 0.3, n).astype(np.float32),
        float(np.log((y[train].mean() + 1e-3) / (1 - y[train].mean() + 1e-3))),
    )
    model.embedding[GAP] = 0
    stops = np.append(starts[1:], len(a))
    params = [model.embedding, *model.filters, model.bias, model.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    parts = max(1, len(train) // batch)

    def add(grads: list[np.ndarray], some: np.ndarray, of: int) -> float:
        """Add the gradients of some texts of a step of `of`; returns that of the base."""
        take = np.concatenate([np.arange(starts[i], stops[i]) for i in some])
        ends = np.cumsum(stops[some] - starts[some])
        lose = rng.random((2, len(take)), np.float32) < drop
        ca, cb = np.where(lose[0], GAP, a[take]), np.where(lose[1], GAP, b[take])
        x, best, where = _pooled(ca, cb, np.append(0, ends[:-1]), ends, model)
        act = np.maximum(best + model.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.base, -30, 30)))
        g = ((p - y[some]) / of).astype(np.float32)
        grads[-1] += act.T @ g
        back = (g[:, None] * model.out) * (act > 0)
        grads[-2] += back.sum(axis=0)
        for k, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(width):
                at = where[k] + o
                grads[1 + k][o] += np.einsum("dfs,df->sf", x[at], part)
                into = np.einsum("df,sf->dfs", part, f[o]).reshape(-1, SIZE)
                np.add.at(grads[0], ca[at].ravel(), into)
                np.add.at(grads[0], cb[at].ravel(), into)
        return float(g.sum())

    for _ in range(max(epochs, -(-least_steps // parts))):
        for chunk in np.array_split(rng.permutation(train), parts):
            grads = [np.zeros_like(q) for q in params]
            cuts = np.flatnonzero(np.diff(np.cumsum(stops[chunk] - starts[chunk]) // BLOCK)) + 1
            moved = sum([add(grads, some, len(chunk)) for some in np.split(chunk, cuts)])
            grads[-1] += 1e-4 * model.out
            model.base -= rate * moved
            grads[0][GAP] = 0
            step += 1
            for q, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    tables, z = model.tables(), []
    for i in hold:
        z.append(model.raw(a[starts[i] : stops[i]], b[starts[i] : stops[i]], np.zeros(1, np.int64), tables)[0])
    calibrate(model, np.asarray(z, float), y[hold], [langs[i] for i in hold])
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str]) -> None:
    """Logistic calibration by Newton steps with a weak prior, then for each language the threshold of best F1 (0.5 without examples)."""
    spread = float(z.std()) or 1.0
    design = np.stack([z / spread, np.ones_like(z)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * w
        hess = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + 0.05 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
    if w[0] > 0:
        model.scale, model.shift = w[0] / spread, w[1]
    s = model.calibrated(z)
    for lang in sorted(set(langs)):
        own = np.array([x == lang for x in langs])
        if own.sum() < 20 or not y[own].any():
            continue
        cuts = np.linspace(0.1, 0.9, 33)
        f1 = np.array([2 * ((s[own] >= c) & (y[own] == 1)).sum() / (((s[own] >= c).sum() + y[own].sum()) or 1) for c in cuts])
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        model.thresholds[lang] = float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text is 2 modulo 4; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, each: int, size: int) -> DataFrame:
    """(doc_id, toxic, lang, text): labelled rows of either label that aren't held out, in the order of their ids' hashes.

    At most `each` rows of a label and `size` bytes of their texts. An id with two labels has the greater, one with
    several texts the least.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id"))
    chosen = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for t in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * each rows
    found = docs.select("doc_id", utf8(F.col("text")).alias("text"), "lang").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("least"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over `each` rows
    held = found.select("doc_id", "toxic", "least.lang", "least.text").withColumn("_sum", F.sum(F.octet_length("text").cast("long")).over(before))
    return held.filter(F.col("_sum") <= size).drop("_sum")


def train(docs: DataFrame, labels: DataFrame, each: int = 3000, size: int = 32_000_000) -> Model:
    """Fit on a bounded sample() of labelled rows, none of them held out. The driver gets their words' rows, not their texts."""
    whole_text_batches(docs.sparkSession)

    def encoded(batches):
        claim("toxicity")
        for b in batches:
            for i in range(b.num_rows):
                x, y, _ = encode([b.column("text")[i].as_py()])
                lists = [pa.array([x], pa.list_(pa.int32())), pa.array([y], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, 1) for c in ("doc_id", "toxic", "lang")] + lists, ["doc_id", "toxic", "lang", "a", "b"])

    rows = sample(docs, labels, each, size).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    got = rows.mapInArrow(encoded, "doc_id long, toxic int, lang string, a array<int>, b array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fitted(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), [], [])
    a, b = (got[c].combine_chunks() if got[c].num_chunks != 1 else got[c].chunk(0) for c in ("a", "b"))
    starts = a.offsets.to_numpy()[:-1].astype(np.int64) - a.offsets[0].as_py()
    return fitted(a.flatten().to_numpy(), b.flatten().to_numpy(), starts, got["toxic"].to_numpy(), got["lang"].to_pylist())


_MODELS: dict[str, tuple] = {}
held("toxicity", _MODELS)


def opened(mark: str, model: Model) -> tuple:
    """A model and its tables, kept in the Python worker for the tasks that follow; the latest model only."""
    claim("toxicity")
    if mark not in _MODELS:
        _MODELS.clear()
        _MODELS[mark] = model, model.tables()
    return _MODELS[mark]


def score(df: DataFrame, model: Model, text: str = "text", lang: str | None = "lang", carry: list[str] | None = None) -> DataFrame:
    """df (of its columns those in carry, all by default) with score, threshold (of the row's language, 0.5 for unknown ones) and rejected (score >= threshold).

    Null and empty texts get the score of a text without words; texts of any length are scored whole, BLOCK words at a
    time; repeated rows are scored each; an empty table gives no rows. Columns of df may have any names, and those with the
    new names are replaced. Scores come from the text alone.
    """
    new = ("score", "threshold", "rejected")
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    names = df.columns if carry is None else carry
    kept = boxed(df, names, text=utf8(F.col(text)), lang=F.col(lang).cast("string") if lang else F.lit(None).cast("string")).select("text", "row", "lang")
    whole_text_batches(df.sparkSession)

    def run(batches):
        own, tables = opened(*shared.value)
        for b in batches:
            s = own.scores(b.column(0).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64())], [*b.schema.names[1:], "score"])

    scored = kept.mapInArrow(run, kept.drop("text").schema.add("score", "double"))
    at = F.lit(0.5)
    for name, cut in model.thresholds.items():
        at = F.when(F.col("lang") == name, F.lit(cut)).otherwise(at)
    scored = scored.withColumn("threshold", at).withColumn("rejected", F.col("score") >= F.col("threshold"))
    return scored.select(*unboxed(names, new), *new)
