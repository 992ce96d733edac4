"""Confidence bands: the sweep against a grid of points, and growth without a last round."""

from math import ceil, floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpanel import estimate
from counterpanel.functions.simplex import simplex_ls, simplex_path, simplex_segments
from counterpanel.operators import bands
from counterpanel.sources import tables as src


def pool(seed):
    rng = np.random.default_rng(seed)
    j, t0 = int(rng.choice([1, 2, 4, 12, 40])), int(rng.choice([10, 20, 36]))
    X = rng.normal(size=(j, t0 + 2)).cumsum(axis=1)
    y = rng.dirichlet(np.ones(j)) @ X + rng.normal(size=t0 + 2) * rng.choice([0.1, 1, 3])
    y[t0:] += rng.choice([0, 5, -20])
    if seed % 3 == 0 and j > 2:
        X[1] = X[0]
        X[2] = (X[0] + X[j - 1]) / 2
    return X, y, t0


def centred(X, y, t0, idx):
    Z, v = bands.recentred(X, y)
    x = Z[:, idx - 1]
    return Z[:, :t0] @ Z[:, :t0].T + np.outer(x, x), Z[:, :t0] @ v[:t0] + x * v[idx - 1], x


@pytest.mark.parametrize("seed", range(24))
def test_sweep_equals_every_grid_point(seed):
    """More donors than periods, duplicated and collinear donors included."""
    X, y, t0 = pool(seed)
    for idx in (t0 + 1, t0 + 2):
        G, c, x = centred(X, y, t0, idx)
        low, high = bands.effect_range(X, y, t0, idx, X.min(axis=0), X.max(axis=0))
        spans = bands.accepted_spans(simplex_segments(G, c, x, low, high), X, y, t0, idx, 0.1)
        ks = np.arange(floor(low / 0.02), ceil(high / 0.02) + 1)
        thetas = np.round(ks * 0.02, 2)
        W, _ = simplex_path(G, c, x, thetas)
        want = ks[bands._ranks(W, X, y, t0, idx, thetas) / (t0 + 1) > 0.1]
        got = {k for a, b in spans for k in range(ceil(a / 0.02 - 1e-6), floor(b / 0.02 + 1e-6) + 1)}
        assert sorted(got) == want.tolist()


@pytest.mark.parametrize("seed", range(6))
def test_segments_are_optimal_and_join(seed):
    X, y, t0 = pool(seed)
    G, c, x = centred(X, y, t0, t0 + 1)
    low, high = bands.effect_range(X, y, t0, t0 + 1, X.min(axis=0), X.max(axis=0))
    segments = simplex_segments(G, c, x, low, high)
    assert segments[0][0] == low and segments[-1][1] == high
    assert all(a[1] == b[0] for a, b in zip(segments, segments[1:]))
    for start, end, support, p, q in segments:
        for theta in np.linspace(start, end, 5)[1:-1]:
            w = np.zeros(len(c))
            w[support] = p + theta * q
            direct, _ = simplex_ls(G, c - theta * x)
            assert abs(w.sum() - 1) < 1e-8 and w.min() > -1e-7
            assert np.allclose(w @ X[:, :t0], direct @ X[:, :t0], atol=1e-5)


def test_growth_passes_over_every_range(spark):
    rng = np.random.default_rng(2)
    grids, ranges, want = [], [], {}
    for i in range(60):
        lo, hi, pad = int(rng.integers(-20, 0)), int(rng.integers(0, 20)), int(rng.integers(1, 9))
        own = []
        for _ in range(rng.integers(0, 6)):
            a = int(rng.integers(-400, 400))
            own.append((a, a + int(rng.integers(0, 250))))
        grids.append((str(i), lo, hi, pad))
        ranges += [(str(i), p, [{"first": a, "last": b} for a, b in own[p::2]]) for p in range(2)]

        def rounds(edge):
            n = 0
            while any(a <= edge(n) <= b for a, b in own):
                n += 1
            return n

        want[str(i)] = (rounds(lambda n: lo - n * pad), rounds(lambda n: hi + n * pad))
    out = bands.grown_grids(
        spark.createDataFrame(grids, "study_id string, lo bigint, hi bigint, pad bigint"),
        spark.createDataFrame(ranges, "study_id string, period_idx int, ranges array<struct<first: bigint, last: bigint>>"),
    )
    assert {r["study_id"]: (r["lower_rounds"], r["upper_rounds"]) for r in out.collect()} == want


def test_far_band_equals_a_plain_search(make_panel, outcomes, spark, tmp_path):
    """One post period: the grid grows by one step a round, here over a thousand rounds."""
    rng = np.random.default_rng(5)
    t0 = 24
    walks = {f"d{i}": list(rng.normal(size=t0 + 1).cumsum()) for i in range(4)}
    walks["T"] = list(np.array(walks["d1"]) + np.append(60 * rng.normal(size=t0), 3.0))
    names = ["d0", "d1", "d2", "d3"]
    out = estimate(make_panel(walks), ["T"], names, outcomes(t0), compute_ci=True)
    band = out.bands.first()
    assert band["ci_status"] == "found" and max(band["lower_rounds"], band["upper_rounds"]) > 300
    X, y = np.array([walks[n] for n in names]), np.array(walks["T"])
    G, c, x = centred(X, y, t0, t0 + 1)

    def passes(k):
        theta = np.round(np.array([k * 0.1]), 1)
        w, _ = simplex_ls(G, c - theta[0] * x)
        return bands._ranks(w[None, :], X, y, t0, t0 + 1, theta)[0] / (t0 + 1) > 0.1

    k = round(out.series.filter("ci_status IS NOT NULL").first()["diff"] * 10)
    low = high = k
    while passes(low - 1):
        low -= 1
    while passes(high + 1):
        high += 1
    assert (band["lower_ci"], band["upper_ci"]) == (round(low * 0.1, 1), round(high * 0.1, 1))
    # the status is in every post row, and in what is stored
    assert out.series.groupBy("ci_status").count().orderBy("ci_status").collect() == [(None, t0), ("found", 1)]
    path = out.save(f"file://{tmp_path}/out", "csv")["series"]
    back = src.read_results(spark, path, src.STORED_SERIES, "csv")
    assert back.filter(F.col("ci_status") == "found").count() == 1


def test_bounds_do_not_depend_on_how_fine_the_grid_is(make_panel, outcomes):
    rng = np.random.default_rng(8)
    walks = {f"d{i}": list(rng.normal(size=30).cumsum()) for i in range(5)}
    walks["T"] = list(0.5 * np.array(walks["d0"]) + 0.5 * np.array(walks["d3"]) + rng.normal(size=30))
    names = [f"d{i}" for i in range(5)]
    coarse, fine = (
        {r["period_idx"]: (r["lower_ci"], r["upper_ci"]) for r in estimate(make_panel(walks), ["T"], names, outcomes(25), compute_ci=True, step=s).bands.collect()}
        for s in (0.1, 0.001)
    )
    for k, (low, high) in coarse.items():
        assert fine[k][0] <= low < fine[k][0] + 0.1 + 1e-9 and fine[k][1] - 0.1 - 1e-9 < high <= fine[k][1]
