"""Every inference result against a plain re-statement on one small matrix."""

import hashlib

import numpy as np
import pytest

from counterpanel import estimate
from counterpanel.functions.simplex import simplex_ls
from counterpanel.operators.fit import optimality
from counterpanel.operators.series import counterfactual
from tests.conftest import month

T0, T1, J = 24, 5, 6
T = T0 + T1


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    donors = rng.normal(size=(J, T)).cumsum(axis=1) + 20
    treated = {
        "T_a": 0.3 * donors[0] + 0.7 * donors[2] + rng.normal(size=T) * 0.5,
        "T_b": donors[1] * 0.5 + donors[4] * 0.5 + rng.normal(size=T) * 0.8,
    }
    treated["T_a"][T0:] += 2.5
    return {f"d{i}": list(donors[i]) for i in range(J)}, treated


def fit(X, y, use):
    w, _ = simplex_ls(X[:, use] @ X[:, use].T, X[:, use] @ y[use])
    return w


def arrays(data, unit):
    donors, treated = data
    X = np.array([donors[k] for k in sorted(donors)])
    level = X.mean(axis=0)
    return X - level, treated[unit] - level


def naive_ttest(X, y, K):
    pre, taus = np.arange(T0), []
    r = min(T0 // K, T1)
    for k in range(K):
        held = T0 - r * K + np.arange(k * r, (k + 1) * r)
        w = fit(X, y, np.setdiff1d(pre, held))
        gap = y - w @ X
        taus.append(gap[T0:].mean() - gap[held].mean())
    return np.mean(taus), np.sqrt(1 + K * r / T1) * np.std(taus, ddof=1) / np.sqrt(K)


def naive_bands(X, y, step, alpha):
    """Grid search by repeated refits, the grid growing until no edge is accepted."""
    w = fit(X, y, np.arange(T0))
    gap = y - w @ X
    lo_gap, hi_gap = round(gap[T0:].min(), 1), round(gap[T0:].max(), 1)
    factor = gap[:T0].mean() / gap[T0:].mean()
    lo = int(np.floor(round((lo_gap - abs(lo_gap * factor)) / step, 6)))
    hi = int(np.ceil(round((hi_gap + abs(hi_gap * factor)) / step, 6)))
    pad = max(1, int(np.round(round((hi_gap - lo_gap) * 0.33 / step, 6))))

    def accepted(t, k):
        use = np.append(np.arange(T0), t)
        shifted = y.copy()
        shifted[t] -= round(k * step, 1)
        v = fit(X, shifted, use)
        u = np.abs(shifted - v @ X)[use]
        return (u >= u[-1] - 1e-12).mean() > alpha

    while True:
        hull = []
        for t in range(T0, T):
            ks = [k for k in range(lo, hi + 1) if accepted(t, k)]
            hull.append((min(ks), max(ks)))
        low, high = any(a == lo for a, _ in hull), any(b == hi for _, b in hull)
        if not (low or high):
            return [(round(a * step, 1), round(b * step, 1)) for a, b in hull]
        lo, hi = lo - pad * low, hi + pad * high


@pytest.fixture(scope="module")
def result(spark, data):
    from tests.conftest import rows_of

    donors, treated = data
    panel = spark.createDataFrame(
        rows_of({**donors, **treated}), "outcome string, unit string, t date, y double"
    )
    outs = spark.createDataFrame(
        [("x", month(T0), None, None)],
        "outcome string, treatment_date date, start_date date, end_date date",
    )

    def run(**kw):
        return estimate(panel, ["T_a", "T_b"], sorted(donors), outs, **kw)

    return run


@pytest.mark.parametrize("K", [2, 3, 4])
def test_cross_fit_ttest(result, data, K):
    rows = {r["treated"]: r for r in result(folds=K).inference.collect()}
    for unit in ("T_a", "T_b"):
        att, se = naive_ttest(*arrays(data, unit), K)
        assert rows[unit]["att"] == pytest.approx(att, abs=1e-9)
        assert rows[unit]["se"] == pytest.approx(se, abs=1e-9)
        assert rows[unit]["T0"] == T0


@pytest.mark.parametrize("theta0", [0.0, 2.0])
def test_moving_block_pvalue(result, data, theta0):
    rows = {r["treated"]: r for r in result(infer_method="conformal", theta0=theta0).inference.collect()}
    for unit in ("T_a", "T_b"):
        X, y = arrays(data, unit)
        y = y.copy()
        y[T0:] -= theta0
        u = np.abs(y - fit(X, y, np.arange(T)) @ X)
        stats = [np.roll(u, -s)[T0:].sum() for s in range(T)]
        p = np.mean([s >= stats[0] - 1e-9 for s in stats])
        assert rows[unit]["pval"] == pytest.approx(p)
        assert (p * T) == pytest.approx(round(p * T))


def test_iid_pvalue(result, data):
    out = result(infer_method="conformal", permutation="iid", n_perm=250, seed=7).inference.collect()
    for row in out:
        X, y = arrays(data, row["treated"])
        u = np.abs(y - fit(X, y, np.arange(T)) @ X)
        hits = 0
        for b in range(1, 251):
            keys = [hashlib.md5(f"7:{b}:{i + 1}".encode()).hexdigest() for i in range(T)]
            hits += u[np.argsort(keys)[:T1]].sum() >= u[T0:].sum() - 1e-9
        assert row["pval"] == pytest.approx((1 + hits) / 251)


def test_bands_equal_the_plain_search(result, data):
    res = result(compute_ci=True, step=0.1)
    assert {r["ci_status"] for r in res.bands.collect()} == {"found"}
    rows = res.series.orderBy("treated", "date").collect()
    for unit in ("T_a", "T_b"):
        mine = [r for r in rows if r["treated"] == unit]
        assert all(r["lower_ci"] is None and r["upper_ci"] is None for r in mine[:T0])
        want = naive_bands(*arrays(data, unit), 0.1, 0.1)
        assert [(r["lower_ci"], r["upper_ci"]) for r in mine[T0:]] == want


def test_wide_pools_give_the_same_results(result):
    a = result(compute_ci=True, infer_method="conformal")
    b = result(compute_ci=True, infer_method="conformal", max_pool=2)
    for one, two in ((a.series, b.series), (a.weights, b.weights), (a.inference, b.inference)):
        x = one.toPandas().sort_values(["outcome", "treated", "placebo", one.columns[0]]).reset_index(drop=True)
        y = two.toPandas().sort_values(["outcome", "treated", "placebo", two.columns[0]]).reset_index(drop=True)
        assert list(x.columns) == list(y.columns) and len(x) == len(y)
        for c in x.columns:
            if x[c].dtype.kind == "f":
                assert np.allclose(x[c], y[c], atol=1e-9, equal_nan=True), c
            else:
                assert (x[c].fillna("") == y[c].fillna("")).all(), c


def test_certificate_rejects_wrong_weights_beside_a_huge_donor(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(4, 24)).cumsum(axis=1)
    X[3] *= 1e6
    y = 0.3 * X[0] + 0.7 * X[1]
    names = ["a", "b", "c", "huge"]
    series_of = [("k", u, "control", 20, 4, x.tolist()) for u, x in zip(names, X)] + [("k", "y", "treated", 20, 4, y.tolist())]
    packed = spark.createDataFrame(series_of, "batch_id string, unit string, role string, T0 int, T1 int, xs array<double>")
    tried = {"right": {"a": 0.3, "b": 0.7}, "vertex": {"b": 1.0}, "other": {"c": 1.0}, "far": {"huge": 1.0}}
    study = spark.createDataFrame([(k, "k") for k in tried], "study_id string, batch_id string")
    weights = spark.createDataFrame(
        [(k, "k", "y", "main", u, w) for k, own in tried.items() for u, w in own.items()],
        "study_id string, batch_id string, treated string, fit_id string, unit string, w double",
    )
    slack = {r["study_id"]: r["slack"] for r in optimality(study, packed, weights, counterfactual(packed, weights)).collect()}
    assert slack["right"] > -1e-9
    assert all(slack[k] < -1e-3 for k in ("vertex", "other", "far"))


def test_cross_products_do_not_depend_on_buckets(spark, data):
    from counterpanel.operators import fit
    from tests.test_inference import T0 as t0, T1 as t1

    donors, treated = data
    rows = [("b", u, "control", t0, t1, [float(x) for x in xs]) for u, xs in donors.items()]
    rows += [("b", u, "treated", t0, t1, [float(x) for x in xs]) for u, xs in treated.items()]
    packed = spark.createDataFrame(
        rows, "batch_id string, unit string, role string, T0 int, T1 int, xs array<double>"
    )
    a, b = (
        {(r["block"], r["i"], r["j"]): r["g"] for r in fit.gram_matrix(packed, bucket_size=k).collect()}
        for k in (256, 2)
    )
    assert a.keys() == b.keys() and len(a) == 4 * (J * (J + 1) // 2 + 2 * J)
    assert all(a[k] == pytest.approx(b[k]) for k in a)
    total = sum(v for (_, i, j), v in a.items() if (i, j) == ("T_a", "d3"))
    assert total == pytest.approx(np.dot(treated["T_a"], donors["d3"]))
