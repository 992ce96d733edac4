import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from counterpanel.functions.scalars import step_decimals, t_quantile
from counterpanel.functions.simplex import simplex_ls, simplex_path


def problem(seed, t, j):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(j, t)).cumsum(axis=1)
    y = rng.dirichlet(np.ones(j)) @ X + rng.normal(size=t) * rng.choice([0.1, 3.0])
    return X, y


def assert_optimal(G, c, w):
    scale = max(np.abs(np.diag(G)).max(), np.abs(c).max())
    g = G @ w - c
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0
    assert (g - g @ w).min() >= -1e-9 * scale


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 40), st.integers(1, 30))
def test_solution_meets_the_optimality_conditions(seed, t, j):
    X, y = problem(seed, t, j)
    G, c = X @ X.T, X @ y
    w, support = simplex_ls(G, c)
    assert_optimal(G, c, w)
    assert set(support) == set(np.flatnonzero(w))


def test_duplicated_donors_leave_the_objective_unchanged():
    X, y = problem(3, 20, 6)
    twice = np.vstack([X, X[2], X[4]])
    w, _ = simplex_ls(X @ X.T, X @ y)
    v, _ = simplex_ls(twice @ twice.T, twice @ y)
    assert np.allclose(w @ X, v @ twice, atol=1e-9)


def test_more_donors_never_fit_worse():
    X, y = problem(4, 12, 30)
    loss = []
    for j in (1, 5, 10, 20, 30):
        w, _ = simplex_ls(X[:j] @ X[:j].T, X[:j] @ y)
        loss.append(((y - w @ X[:j]) ** 2).sum())
    assert all(b <= a + 1e-9 for a, b in zip(loss, loss[1:]))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("j", [1, 2, 7, 25])
def test_path_equals_separate_solves(seed, j):
    X, y = problem(seed, 15, j)
    pre, x = X[:, :14], X[:, 14]
    G, c0 = pre @ pre.T + np.outer(x, x), pre @ y[:14] + x * y[14]
    thetas = np.round(np.arange(-150, 150) * 0.1, 1)
    path, ends = simplex_path(G, c0, x, thetas)
    assert ends[0] == 0 and max(ends) == len(thetas) - 1
    for theta, w in zip(thetas, path):
        c = c0 - theta * x
        assert_optimal(G, c, w)
        direct, _ = simplex_ls(G, c)
        assert np.allclose(w @ X, direct @ X, atol=1e-6)


@pytest.mark.parametrize("power", [0, 3, 6, 8])
@pytest.mark.parametrize("seed", range(8))
def test_one_donor_far_larger_than_the_rest(seed, power):
    X, _ = problem(seed, 30, 12)
    y = 0.3 * X[2] + 0.7 * X[6]
    X[9] *= 10.0**power
    w, support = simplex_ls(X @ X.T, X @ y)
    assert np.allclose(w[[2, 6]], [0.3, 0.7], atol=1e-9)
    assert abs(w.sum() - 1) < 1e-12


def test_t_quantiles():
    assert math.isclose(t_quantile(0.95, 1), 6.313751514675041)
    for df, value in {2: 2.919985580, 3: 2.353363435, 4: 2.131846786, 9: 1.833112933, 10: 1.812461123}.items():
        assert math.isclose(t_quantile(0.95, df), value, rel_tol=1e-8)
        assert math.isclose(t_quantile(0.05, df), -value, rel_tol=1e-8)


def test_published_interval_width():
    # att, se and ub of one published row: the interval has one degree of freedom
    att, se, ub = -44.17751586657455, 0.9546364118232696, -38.15017877546144
    assert math.isclose((ub - att) / se, t_quantile(0.95, 1), rel_tol=1e-9)


def test_step_decimals():
    assert [step_decimals(s) for s in (0.1, 0.001, 1e-5, 0.25)] == [1, 3, 5, 2]
    for bad in (0, 1, -0.1, 2):
        with pytest.raises(ValueError):
            step_decimals(bad)
