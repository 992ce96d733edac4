"""Windows, donor filters, rejections and recovery of planted effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpanel import estimate
from tests.conftest import month


def walks(n, t, seed=0):
    rng = np.random.default_rng(seed)
    return {f"d{i}": list(rng.normal(size=t).cumsum() + 50) for i in range(n)}


def weights_of(result):
    return {r["control_unit"]: r["weight"] for r in result.weights.collect()}


def test_planted_effect_is_recovered(make_panel, outcomes):
    d = walks(6, 30)
    y = 0.3 * np.array(d["d1"]) + 0.7 * np.array(d["d4"])
    y[20:] += 5
    r = estimate(make_panel({**d, "T": list(y)}), ["T"], sorted(d), outcomes(20), compute_ci=True)
    w = weights_of(r)
    assert w["d1"] == pytest.approx(0.3, abs=1e-8) and w["d4"] == pytest.approx(0.7, abs=1e-8)
    assert len(w) == 6 and sum(w.values()) == pytest.approx(1, abs=1e-9)
    gaps = [x["diff"] for x in r.series.orderBy("date").collect()]
    assert gaps == pytest.approx([0] * 20 + [5] * 10, abs=1e-8)
    assert r.inference.first()["att"] == pytest.approx(5, abs=1e-8)


def test_levels_common_to_all_units_do_not_matter(make_panel, outcomes):
    d = walks(5, 24, 1)
    d["T"] = list(np.mean([d["d0"], d["d1"], d["d3"]], axis=0) + np.sin(np.arange(24)))
    lift = 1000 * np.cos(np.arange(24) / 3)
    lifted = {k: list(np.array(v) + lift) for k, v in d.items()}
    a, b = (estimate(make_panel(p), ["T"], ["d0", "d1", "d2", "d3", "d4"], outcomes(18)) for p in (d, lifted))
    wa, wb = weights_of(a), weights_of(b)
    assert all(wa[k] == pytest.approx(wb[k], abs=1e-8) for k in wa)


def test_donors_with_holes_in_the_window_are_left_out(make_panel, outcomes, spark):
    d = walks(5, 24, 2)
    d["d0"][3] = None
    d["d1"][5] = "absent"
    d["d2"][23] = None  # outside the window below
    d["T"] = list(np.array(d["d3"]) + 1)
    outs = outcomes(18).withColumn("end_date", F.lit(month(22)).cast("date"))
    panel = make_panel(d)
    window = weights_of(estimate(panel, ["T"], [f"d{i}" for i in range(5)], outs))
    assert set(window) == {"d2", "d3", "d4"}
    whole = weights_of(
        estimate(panel, ["T"], [f"d{i}" for i in range(5)], outs, whole_series_outcomes=["x"])
    )
    assert set(whole) == {"d3", "d4"}


def test_nan_counts_as_missing(make_panel, outcomes):
    d = walks(4, 24, 3)
    d["d0"][2] = float("nan")
    d["T"] = list(np.array(d["d2"]) + 1)
    r = estimate(make_panel(d), ["T"], ["d0", "d1", "d2", "d3"], outcomes(18))
    assert set(weights_of(r)) == {"d1", "d2", "d3"}


def test_row_order_does_not_matter(make_panel, outcomes):
    d = walks(4, 24, 4)
    d["T"] = list(np.array(d["d2"]) * 0.5 + np.array(d["d0"]) * 0.5)
    panel = make_panel(d)
    a = estimate(panel, ["T"], ["d0", "d1", "d2", "d3"], outcomes(18)).series.orderBy("date").collect()
    b = estimate(panel.orderBy(F.rand(3)), ["T"], ["d0", "d1", "d2", "d3"], outcomes(18)).series.orderBy("date").collect()
    assert [r["date"] for r in a] == [month(i) for i in range(24)] == [r["date"] for r in b]
    assert [r["synth"] for r in a] == pytest.approx([r["synth"] for r in b])


def test_duplicate_keys_are_an_error(make_panel, outcomes):
    panel = make_panel(walks(3, 12) | {"T": list(range(12))})
    for check in (True, False):
        with pytest.raises(ValueError, match="not unique"):
            estimate(panel.union(panel.limit(1)), ["T"], ["d0", "d1", "d2"], outcomes(8), check_keys=check)


def test_unknown_outcomes_and_shifts_are_errors(make_panel, outcomes):
    panel = make_panel(walks(3, 12) | {"T": list(range(12))})
    with pytest.raises(ValueError, match="Outcome not in the panel: z. It holds: x"):
        estimate(panel, ["T"], ["d0"], outcomes(8, ("x", "z")))
    for bad in (-1, 71, 1.5):
        with pytest.raises(ValueError, match="between 0 and 70"):
            estimate(panel, ["T"], ["d0"], outcomes(8), shifts=[bad])
    with pytest.raises(ValueError, match="between 0 and 1"):
        estimate(panel, ["T"], ["d0"], outcomes(8), compute_ci=True, step=2)


def test_other_treated_units_are_never_donors(make_panel, outcomes):
    d = walks(4, 24, 5)
    for i in range(3):
        d[f"T{i}"] = list(np.array(d["d0"]) + 0.01 * i)
    r = estimate(make_panel(d), ["T0", "T1", "T2"], ["d0", "d1", "d2", "d3"], outcomes(18))
    got = {(x["treated"], x["control_unit"]) for x in r.weights.collect()}
    assert got == {(f"T{i}", f"d{j}") for i in range(3) for j in range(4)}


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda d: d["T"].__setitem__(4, None), "treated_incomplete"),
        (lambda d: [v.__setitem__(4, None) for k, v in d.items() if k != "T"], "no_complete_donor"),
    ],
)
def test_unusable_studies_are_reported(make_panel, outcomes, change, reason):
    d = walks(3, 24, 6) | {"T": list(np.arange(24.0))}
    change(d)
    r = estimate(make_panel(d), ["T"], ["d0", "d1", "d2"], outcomes(18))
    assert [x["reason"] for x in r.rejected.collect()] == [reason]
    assert r.series.count() == r.weights.count() == r.inference.count() == 0


def test_dates_only_the_treated_unit_has_leave_no_complete_donor(make_panel, outcomes):
    d = {k: v[:10] + ["absent"] + v[11:] for k, v in walks(3, 24, 6).items()} | {"T": list(np.arange(24.0))}
    r = estimate(make_panel(d), ["T"], ["d0", "d1", "d2"], outcomes(18))
    row = r.rejected.first()
    assert (row["reason"], row["T0"], row["T1"]) == ("no_complete_donor", 18, 6)


def test_windows_too_short(make_panel, outcomes):
    d = walks(3, 12, 6) | {"T": list(np.arange(12.0))}
    early = estimate(make_panel(d), ["T"], ["d0", "d1", "d2"], outcomes(1))
    late = estimate(make_panel(d), ["T"], ["d0", "d1", "d2"], outcomes(12))
    assert early.rejected.first()["reason"] == "too_few_pre_periods"
    assert late.rejected.first()["reason"] == "no_post_period"


def test_placebo_windows(make_panel, outcomes):
    d = walks(4, 40, 7)
    d["T"] = list(np.array(d["d1"]) + 1)
    r = estimate(make_panel(d), ["T"], ["d0", "d1", "d2", "d3"], outcomes(32), shifts=[0, 3, 10])
    sizes = {k: len(list(g)) for k, g in _by(r.series.collect(), "placebo").items()}
    assert sizes == {"FALSE": 40, "time_3": 29 + 8, "time_10": 22 + 8}
    t0 = {x["placebo"]: x["T0"] for x in r.inference.collect()}
    assert t0 == {"FALSE": 32, "time_3": 29, "time_10": 22}
    capped = estimate(make_panel(d), ["T"], ["d0", "d1", "d2", "d3"], outcomes(32), shifts=[10], t1_cap=4)
    assert capped.series.count() == 22 + 4


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_short_pre_window_has_no_bounds(make_panel, outcomes):
    d = walks(4, 12, 8)
    d["T"] = list(np.array(d["d1"]) + 1)
    r = estimate(make_panel(d), ["T"], ["d0", "d1", "d2", "d3"], outcomes(8), compute_ci=True)
    assert {(b["ci_status"], b["lower_ci"], b["upper_ci"]) for b in r.bands.collect()} == {("unbounded", None, None)}


def test_one_post_period_still_grows_its_grid(make_panel, outcomes):
    d = walks(4, 25, 9)
    rng = np.random.default_rng(1)
    d["T"] = list(np.array(d["d1"]) + rng.normal(size=25))
    r = estimate(make_panel(d), ["T"], ["d0", "d1", "d2", "d3"], outcomes(24), compute_ci=True)
    band = r.bands.first()
    assert band["ci_status"] == "found" and band["lower_ci"] < band["upper_ci"]


def test_collinear_donors(make_panel, outcomes):
    d = walks(3, 24, 10)
    d["T"] = list(0.5 * np.array(d["d0"]) + 0.5 * np.array(d["d1"]))
    single = estimate(make_panel(d), ["T"], ["d0", "d1", "d2"], outcomes(18)).series.orderBy("date").collect()
    d["d3"] = list(d["d0"])
    double = estimate(make_panel(d), ["T"], ["d0", "d1", "d2", "d3"], outcomes(18)).series.orderBy("date").collect()
    assert [r["synth"] for r in single] == pytest.approx([r["synth"] for r in double], abs=1e-8)


def test_many_outcomes_in_one_run(spark, make_panel, outcomes):
    parts = []
    for k, name in enumerate(("x", "z")):
        d = walks(4, 24, 20 + k)
        d["T"] = list(np.array(d[f"d{k}"]))
        parts.append(make_panel(d, name))
    r = estimate(parts[0].unionByName(parts[1]), ["T"], ["d0", "d1", "d2", "d3"], outcomes(18, ("x", "z")))
    top = {(x["outcome"], x["control_unit"]) for x in r.weights.collect() if x["weight"] > 0.99}
    assert top == {("x", "d0"), ("z", "d1")}
