"""The whole two-country study on made-up CSV inputs."""

from datetime import date

import numpy as np
import pytest

from counterpanel.plans import price_study as ps


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    folder = tmp_path_factory.mktemp("inputs")
    units = (*ps.TREATED, *ps.CONTROLS, "UK")
    months = [date(2013 + i // 12, i % 12 + 1, 1) for i in range(12 * 11 + 6)]
    prices, index = ["date,country,DAP"], ["geo,coicop,TIME_PERIOD,values"]
    for u in units:
        level = rng.normal(size=len(months)).cumsum() + 60
        for m, y in zip(months, level):
            if m >= date(2015, 1, 1) and m <= date(2023, 12, 1) and u not in ("BG", "HR"):
                text = "NA" if (u, m) == ("IE", date(2016, 3, 1)) else f"{y:.4f}"
                prices.append(f"{m},{u},{text}")
        for code in ("NRG", "TOT_X_NRG", "CP00"):
            for m, y in zip(months, rng.normal(size=len(months)).cumsum() + 100):
                index.append(f"{u},{code},{m},{y:.4f}")
    (folder / "price.csv").write_text("\n".join(prices) + "\n")
    (folder / "index.csv").write_text("\n".join(index) + "\n")
    panel = ps.price_panel(spark, str(folder / "price.csv"), str(folder / "index.csv"))
    return ps.run_price_study(panel, step=0.1)


def test_windows_and_pools_match_the_published_sizes(study):
    t0 = {(r["outcome"], r["placebo"]): r["T0"] for r in study.result.inference.collect()}
    for o in ps.INDEX_OUTCOMES:
        assert (t0[(o, "FALSE")], t0[(o, "time_48")]) == (108, 60)
    assert (t0[("DAP", "FALSE")], t0[("DAP", "time_48")]) == (89, 41)
    counts = {
        (r["outcome"], r["treated"]): r["count"]
        for r in study.result.weights.filter("placebo = 'FALSE'").groupBy("outcome", "treated").count().collect()
    }
    assert counts[("DAP", "ES")] == 20 and counts[("CP00", "PT")] == 23
    assert study.result.weights.filter("placebo = 'FALSE'").count() == 178
    assert study.result.inference.count() == 16


def test_series_lengths_and_rates(study):
    n = {(r["outcome"], r["placebo"]): r["count"] for r in study.result.series.groupBy("outcome", "placebo").count().collect()}
    assert n[("NRG", "FALSE")] == 2 * (108 + 19) and n[("NRG", "time_48")] == 2 * (60 + 19)
    rows = study.rates.collect()
    assert {r["outcome"] for r in rows} == set(ps.INDEX_OUTCOMES)
    assert max(r["date"] for r in rows) == date(2023, 6, 1)
    assert study.frame.count() == 3 * (2 * 108 + 3 * 2 * 127)
    assert {r["country"] for r in study.frame.select("country").distinct().collect()} == {"Spain", "Portugal"}
