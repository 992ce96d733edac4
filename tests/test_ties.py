"""One answer where several weights fit equally well, at every pool limit."""

import numpy as np
import pytest

from counterpanel import estimate
from counterpanel.functions.simplex import closest_weights, simplex_ls, tie_costs
from tests.conftest import rows_of


def pool(seed):
    """More donors than periods; every third pool has duplicates and a donor in line."""
    rng = np.random.default_rng(seed)
    t0, j = int(rng.choice([3, 6, 10, 20])), int(rng.choice([4, 8, 15, 40, 120]))
    X = rng.normal(size=(j, t0)).cumsum(axis=1)
    if seed % 3 == 0:
        X[j // 2] = X[0]
        X[j // 3] = (X[1] + X[2]) / 2
    y = rng.dirichlet(np.ones(j)) @ X + (rng.normal(size=t0) * 0.5 if seed % 4 == 0 else 0)
    return rng, X, y


@pytest.mark.parametrize("seed", range(30))
def test_weights_do_not_depend_on_the_order_of_donors(seed):
    rng, X, y = pool(seed)
    names = np.array([f"u{i}" for i in range(len(X))])
    found = []
    for k in range(3):
        order = rng.permutation(len(X)) if k else np.arange(len(X))
        G, c = X[order] @ X[order].T, X[order] @ y
        start, _ = simplex_ls(G, c)
        cost = tie_costs(X[order], y, names[order].tolist())
        w, _ = closest_weights(X[order], G, c, start, cost)
        assert np.allclose(w @ X[order], start @ X[order], atol=1e-8) and w.min() >= 0
        assert cost @ w <= cost @ start * (1 + 1e-9)
        whole = np.zeros(len(X))
        whole[order] = w
        found.append(whole)
    assert np.allclose(found[0], found[1], atol=1e-8) and np.allclose(found[0], found[2], atol=1e-8)


@pytest.mark.parametrize("seed", range(12))
def test_no_other_minimiser_costs_less(seed):
    """Against all basic solutions of a small pool that fits exactly."""
    from itertools import combinations

    rng = np.random.default_rng(seed)
    X = rng.normal(size=(7, 2))
    y = rng.dirichlet(np.ones(7)) @ X
    G, c = X @ X.T, X @ y
    cost = tie_costs(X, y, [f"u{i}" for i in range(7)])
    w, _ = closest_weights(X, G, c, simplex_ls(G, c)[0], cost)
    best = np.inf
    for own in combinations(range(7), 3):
        A = np.vstack([X[list(own)].T, np.ones(3)])
        v = np.linalg.solve(A, np.append(y, 1.0))
        if v.min() >= -1e-12:
            best = min(best, cost[list(own)] @ v)
    assert cost @ w == pytest.approx(best, rel=1e-8)


@pytest.mark.parametrize("method", ["ttest", "conformal"])
def test_pool_limits_do_not_change_results(spark, outcomes, method):
    """Forty donors over ten periods, two of them equal and one in line with others."""
    rng = np.random.default_rng(3)
    t0, t1 = 10, 4
    X = rng.normal(size=(40, t0 + t1)).cumsum(axis=1)
    X[21], X[22] = X[20], (X[4] + X[5]) / 2
    series = {f"d{i:02d}": list(x) for i, x in enumerate(X)}
    for k in range(2):
        series[f"T{k}"] = list(rng.dirichlet(np.ones(40)) @ X + np.append(np.zeros(t0), 1.5 + rng.normal(size=t1)))
    series["T2"] = list(X[7] + rng.normal(size=t0 + t1) * 2)
    panel = spark.createDataFrame(rows_of(series), "outcome string, unit string, t date, y double")
    names = [f"d{i:02d}" for i in range(40)]
    out = []
    for limit in (512, 10):
        r = estimate(panel, ["T0", "T1", "T2"], names, outcomes(t0), infer_method=method, compute_ci=method == "ttest", step=0.1, max_pool=limit)
        tables = [r.series.orderBy("treated", "date"), r.inference.orderBy("treated"), r.weights.orderBy("treated", "control_unit")]
        out.append([t.toPandas() for t in tables])
    for a, b in zip(*out):
        assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
        for col in a.columns:
            if a[col].dtype.kind == "f":
                assert np.allclose(a[col], b[col], atol=1e-8, equal_nan=True), (col, abs(a[col] - b[col]).max())
            else:
                assert (a[col].fillna("") == b[col].fillna("")).all(), col
