import numpy as np

from conjunct.plans import lasso


def test_path():
    r = np.random.default_rng(2)
    x = (r.random((120, 15)) < 0.4).astype(float)
    y = 3 + 2 * x[:, 0] - x[:, 3] + 0.1 * r.normal(size=120)
    points = lasso.lasso_path(x, y, [1.0, 0.3, 0.01])
    assert not points[0].w.any() and abs(points[0].b - y.mean()) < 1e-12
    for p in points:
        assert p.gap <= 1.01e-8 * y.var() and p.kkt <= 1e-4
        lam = p.tau * lasso.alpha_max(x, y)
        value = lambda w: ((y - p.b - x @ w) ** 2).mean() / 2 + lam * np.abs(w).sum()
        assert all(value(p.w) <= value(p.w + 1e-3 * r.normal(size=15)) + 1e-9 for _ in range(50))
    assert set(np.flatnonzero(points[1].w)) == {0, 3}


def test_compact_refit_prefers_small():
    r = np.random.default_rng(3)
    x = (r.random((300, 30)) < 0.5).astype(float)
    y = r.poisson(np.exp(1 + x[:, 0] - x[:, 1])).astype(float)
    assert lasso.compact_refit(x, y, np.arange(30), np.arange(300) % 3, sizes=(2, 8, 20))[0] == 2


def test_bootstrap():
    r = np.random.default_rng(4)
    y = r.normal(size=200)
    out = lasso.bootstrap_intervals(y, y + 1, y + 0.1 * r.normal(size=200), 300)
    assert 0 < out["low"] < out["high"] and out["positive"] == 1.0
    same = lasso.bootstrap_intervals(y, y + 1, y + 1, 50)
    assert same == {"low": 0.0, "high": 0.0, "positive": 0.0}


def test_cross_validated_lasso():
    r = np.random.default_rng(3)
    x = (r.random((90, 6)) < 0.5).astype(float)
    y = 1 + 3 * x[:, 1] + 0.1 * r.normal(size=90)
    folds = np.arange(90) % 3
    point, means = lasso.run_lasso(x, y, folds, [1.0, 0.3, 0.05])
    assert point.tau == [1.0, 0.3, 0.05][int(np.argmin(means))] and abs(point.w[1]) > 2


def test_records_of_failures():
    x, y = np.ones((3, 1)), np.arange(3.0)
    good = lasso.record("mean", lambda x, y: lambda held: np.full(len(held), y.mean()), x, y, x[:2])
    bad = lasso.record("bad", lambda x, y: 1 / 0, x, y, x)
    assert good["status"] == "complete" and good["prediction"] == [1.0, 1.0] and bad["status"] == "failed" and "ZeroDivisionError" in bad["error"]
