"""Enumeration, scoring and the solver against brute force."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from conjunct.functions import scalar
from conjunct.operators import itemsets, scoring
from conjunct.plans import path, solver

TINY = [([0, 1, 2], 11.0), ([0, 1, 2], 8.0), ([0, 1], 4.0), ([1], 2.0), ([2], 1.0), ([], 3.0)]


def tables(spark, rows):
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "tid long, items array<int>, y double")
    return itemsets.long_form(df), df.select("tid", "y")


def brute(rows, least, max_len):
    items = sorted({x for t, _ in rows for x in t})
    out = {}
    for k in range(1, max_len + 1):
        for p in itertools.combinations(items, k):
            tids = [i for i, (t, _) in enumerate(rows) if set(p) <= set(t)]
            if len(tids) >= least:
                closure = tuple(sorted(set.intersection(*[set(rows[i][0]) for i in tids])))
                out[p] = tids, closure
    return out


@pytest.mark.parametrize("max_len", [1, 2, 3])
def test_tiny_dictionary(spark, max_len):
    item_tid, response = tables(spark, TINY)
    found = itemsets.pattern_tids(item_tid, 1, max_len)
    want = brute(TINY, 1, max_len)
    assert {tuple(r.itemset): r.support for r in itemsets.supports(found).collect()} == {p: len(t) for p, (t, _) in want.items()}
    closed = itemsets.closed(found, item_tid)
    assert {tuple(r.itemset): r.support for r in closed.collect()} == {p: len(t) for p, (t, c) in want.items() if c == p}
    scored = scoring.sums(found.join(closed.select("itemset"), "itemset", "left_semi"), scoring.centered(response), ["alpha"])
    best = scoring.lambda_max(scored).first()
    assert best.lambda_max == pytest.approx({1: 5.666667, 2: 8.5, 3: 9.333333}[max_len], abs=1e-6)


def test_random_dictionaries(spark):
    r = np.random.default_rng(3)
    rows = [([int(x) for x in np.flatnonzero(r.random(7) < 0.45)], float(r.poisson(3))) for _ in range(60)]
    item_tid, _ = tables(spark, rows)
    found = itemsets.pattern_tids(item_tid, 4, 4)
    want = brute(rows, 4, 4)
    assert {tuple(x.itemset): tuple(x.closure) for x in itemsets.closures(found, item_tid).collect()} == {p: c for p, (_, c) in want.items()}
    held = [t for t, _ in rows[:20]]
    sub = item_tid.filter("tid < 20")
    got = {tuple(x.itemset): x.support for x in itemsets.transform_patterns(found.select("itemset").distinct(), sub).collect()}
    assert got == {p: sum(set(p) <= set(t) for t in held) for p in want}
    twos = found.filter(F.size("itemset") == 2).select("itemset").distinct()
    have = {p for p in want if len(p) == 2}
    cands = {p for p in itertools.combinations(range(7), 3) if all(q in have for q in itertools.combinations(p, 2))}
    assert {tuple(x.itemset) for x in itemsets.propagate(twos).collect()} == cands


def test_bounds_hold_on_sampled_duals(spark):
    r = np.random.default_rng(1)
    n = 12
    one, two = r.normal(size=n), r.normal(size=n)
    one, two = one - one.mean(), two - two.mean()
    gap = float(np.linalg.norm(one - two))
    r1, r2 = 0.7 * gap, 0.6 * gap
    masks = [r.random(n) < 0.5 for _ in range(20)]
    rows = [(i, float(one[m].sum()), float(two[m].sum()), float(m.sum())) for i, m in enumerate(masks)]
    df = spark.createDataFrame(rows, "i int, a1 double, a2 double, s double")
    bounds = {x.i: x.b for x in df.select("i", scalar.two_ball_bound(F.col("a1"), F.col("a2"), F.col("s"), r1, r2, gap * gap, n).alias("b")).collect()}
    for _ in range(3000):
        d = r.normal(size=n)
        d -= d.mean()
        a = one + d / np.linalg.norm(d) * r1 * r.random() ** (1 / n)
        if np.linalg.norm(a - two) <= r2:
            for i, m in enumerate(masks):
                assert abs(a[m].sum()) <= bounds[i] + 1e-9


def test_solver_is_optimal():
    r = np.random.default_rng(0)
    x = (r.random((300, 12)) < 0.4).astype(float)
    y = r.poisson(np.exp(0.5 + x[:, 0] - 0.7 * x[:, 1])).astype(float)
    top = np.abs(x.T @ (y - y.mean())).max()
    for tau in (1.0, 0.3, 0.05):
        fit = solver.solve(x, y, tau * top, 0.05)
        assert fit.kkt <= 1e-9
        alpha = solver.feasible(y, fit.mu)
        _, value = solver.best_scale(y, alpha, (c := x.T @ alpha)[np.abs(c) > tau * top], tau * top, 0.05)
        assert 0 <= fit.value - value + 1e-9 <= 1e-5 * len(y)
    with pytest.raises(ValueError):
        solver.solve(x, np.zeros(300), 1.0, 0.05)


def test_path_equals_full_dictionary(spark):
    subsets = [list(s) for k in range(4) for s in itertools.combinations(range(3), k)]
    rows = [(t, 3.0 + 5 * (0 in t and 1 in t) + i % 3) for i, t in enumerate(subsets * 4)]
    item_tid, response = tables(spark, rows)
    d = path.Dictionary(item_tid, response, 2, 3)
    points = path.fit_path(d, [1.0, 0.3, 0.1])
    assert points[0].rounds == 0 and not points[0].w
    want = brute(rows, 2, 3)
    full = [p for p, (_, c) in want.items() if c == p]
    x = np.array([[float(set(p) <= set(t)) for p in full] for t, _ in rows])
    y = np.array([v for _, v in rows])
    top = np.abs(x.T @ (y - y.mean())).max()
    for p in points:
        best = solver.solve(x, y, p.tau * top, 0.05)
        eta = p.b + sum(v * x[:, full.index(q)] for q, v in p.w.items())
        assert p.converged and p.gap / len(y) <= 1e-7
        np.testing.assert_allclose(eta, math.log(1) + best.b + x @ best.w, rtol=3e-5, atol=3e-5)
        found = path.audit(d, p, 0.05)
        assert found["gap"] <= 1.01e-7 and found["kkt"] <= 1.01e-7


def test_poisson_glm_gradient():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(200, 3)), r.poisson(2, 200).astype(float)
    b, w = solver.poisson_glm(x, y, 0.1)
    mu = np.exp(b + x @ w)
    assert np.abs(x.T @ (mu - y) / 200 + 0.1 * w).max() < 1e-8 and abs((mu - y).mean()) < 1e-8


def test_segment_and_older_solver():
    r = np.random.default_rng(4)
    x = (r.random((150, 8)) < 0.4).astype(float)
    y = r.poisson(np.exp(0.4 + x[:, 0] - 0.5 * x[:, 2])).astype(float)
    lam = 0.3 * np.abs(x.T @ (y - y.mean())).max()
    ends = [solver.feasible(y, solver.solve(x, y, f * lam, 0.05).mu) for f in (1.0, 2.0)]
    c = [x.T @ a for a in ends]
    t, value = solver.best_segment(y, *ends, *c, lam, 0.05)
    at = lambda t: solver.dual(y, (1 - t) * ends[0] + t * ends[1], float((np.maximum(np.abs(x.T @ ((1 - t) * ends[0] + t * ends[1])) - lam, 0) ** 2).sum() / 0.1))
    assert 0 <= t <= 1 and value >= max(map(at, np.linspace(0, 1, 101))) - 1e-6
    best, old = solver.solve(x, y, lam, 0.05), solver.fista(x, y, lam, 0.05, tol=1e-7)
    assert old.kkt <= 1e-6 and old.value == pytest.approx(best.value, rel=1e-7)
    np.testing.assert_allclose(old.w, best.w, atol=1e-3)


def fixture_tables(spark):
    subsets = [list(s) for k in range(4) for s in itertools.combinations(range(3), k)]
    rows = [(t, 3.0 + 5 * (0 in t and 1 in t) + i % 3) for i, t in enumerate(subsets * 4)]
    return rows, *tables(spark, rows)


def test_arms_keep_the_active_patterns(spark):
    _, item_tid, response = fixture_tables(spark)
    d = path.Dictionary(item_tid, response, 2, 3)
    config = path.Config()
    points = path.fit_path(d, [1.0, 0.5, 0.2], config)
    got = {(r.point, r.arm): r.kept for r in path.ablation(d, points, config).collect()}
    for k in (1, 2):
        active = sum(v != 0 for v in points[k].w.values())
        assert got[k, "none"] == d.size and all(active <= got[k, a] <= d.size for a in path.ARMS)
        assert got[k, "vu_two"] <= got[k, "vu_single"] <= min(got[k, "u_only"], got[k, "v_only"])
    record = path.package(points[2])
    assert len(record["w"]) == len(record["patterns"]) and all(record["w"])


def test_cross_validated_choice(spark):
    _, item_tid, response = fixture_tables(spark)
    folds = response.select("tid", (F.col("tid") % 3).cast("int").alias("fold"))
    taus = [1.0, 0.1]
    for score in ("nll", "rmse"):
        tau, rows = path.fit_cv(item_tid, response, folds, taus, lambda n: 2, 2, score=score)
        means = {t: np.mean([v for _, u, v in rows if u == t]) for t in taus}
        assert len(rows) == 6 and tau == min(taus, key=lambda t: means[t]) == 0.1


def test_lists_in_blocks(spark, monkeypatch):
    """Patterns whose rows are cut into several lists have the same sums."""
    _, item_tid, response = fixture_tables(spark)
    whole = path.Dictionary(item_tid, response, 2, 3)
    monkeypatch.setattr(path, "BLOCK", 5)
    cut = path.Dictionary(item_tid, response, 2, 3)
    a = whole.y - whole.y.mean()
    one, two = ({tuple(r.itemset): tuple(r)[1:] for r in d.scored(alpha=a).collect()} for d in (whole, cut))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    assert cut.lists.count() > whole.lists.count() and whole.lambda_max() == (pytest.approx(cut.lambda_max()[0]), cut.lambda_max()[1])


def test_path_holds_no_rows_on_the_driver(spark, monkeypatch):
    """A path by sums over blocks is that of rows held together, and takes less of the driver than a number a row."""
    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("tid"), F.expr("filter(array(0, 1, 2, 3), i -> (id * 7 + id div 16) % (i + 2) = 0)").alias("items"))
    rows = rows.withColumn("y", F.expr("3 + tid % 3 + size(items) + 5 * cast(array_contains(items, 0) and array_contains(items, 1) as int)"))
    item_tid, response = itemsets.long_form(rows), rows.select("tid", "y")
    want = path.fit_path(path.Dictionary(item_tid, response, 1000, 2), [1.0, 0.3])
    for partial in (0, 1 << 23):
        monkeypatch.setattr(path, "HELD", 0)
        monkeypatch.setattr(path, "PARTIAL", partial)
        tracemalloc.start()
        points = path.fit_path(path.Dictionary(item_tid, response, 1000, 2), [1.0, 0.3])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 8 * n
        for p, q in zip(points, want, strict=True):
            assert p.converged and q.converged and p.lam == pytest.approx(q.lam) and p.w.keys() == q.w.keys() and p.excluded == q.excluded
            assert p.b == pytest.approx(q.b, abs=1e-7) and all(p.w[k] == pytest.approx(q.w[k], abs=1e-7) for k in p.w)
    assert len(want[1].w) > 1


def test_nested_containment(spark):
    item_tid, _ = tables(spark, TINY)
    few = [[0, 1], [2], [0, 2]]
    want = {(tuple(p), i) for p in few for i, (t, _) in enumerate(TINY) if set(p) <= set(t)}
    patterns = spark.createDataFrame([(p,) for p in few], "itemset array<int>")
    for got in (itemsets.contain_join_nested(few, item_tid), itemsets.contain_join(patterns, item_tid)):
        assert {(tuple(r.itemset), r.tid) for r in got.collect()} == want
