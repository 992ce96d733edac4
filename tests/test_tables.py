"""Sources, sinks, checks, rates and report tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from counterpanel import estimate
from counterpanel.operators import checks, panel as shaping, rates, report
from counterpanel.sources import tables as src
from tests.conftest import month
from tests.test_studies import walks


def test_csv_scan_reads_na_and_rejects_other_text(spark, tmp_path):
    good, bad = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text("date,country,DAP\n2015-01-01,ES,51.8\n2015-01-01,PT,NA\n")
    bad.write_text("date,country,DAP\n2015-01-01,ES,many\n")
    rows = src.read_table(spark, str(good), src.PRICE_SCHEMA).orderBy("country").collect()
    assert [tuple(r) for r in rows] == [(date(2015, 1, 1), "ES", 51.8), (date(2015, 1, 1), "PT", None)]
    with pytest.raises(Exception):
        src.read_csv(spark, str(bad), src.PRICE_SCHEMA).collect()


def test_two_sources_make_one_panel(spark):
    price = spark.createDataFrame([(month(0), "ES", float("nan")), (month(1), "ES", 2.0)], src.PRICE_SCHEMA)
    index = spark.createDataFrame([("ES", "TOT_X_NRG", month(0), 99.0)], src.INDEX_SCHEMA)
    renamed = index.withColumn("coicop", shaping.recode(F.col("coicop"), {"TOT_X_NRG": "xNRG"}))
    both = shaping.union_panels(
        shaping.project_panel(price, "country", "date", "DAP", F.lit("DAP")),
        shaping.project_panel(renamed, "geo", "TIME_PERIOD", "values", "coicop"),
    )
    assert {tuple(r) for r in both.collect()} == {
        ("DAP", "ES", month(0), None),
        ("DAP", "ES", month(1), 2.0),
        ("xNRG", "ES", month(0), 99.0),
    }


def test_source_is_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def builder(s):
        calls.append(1)
        return s.range(3)

    assert src.load_or_build(spark, path, builder).count() == 3
    assert src.load_or_build(spark, path, builder).count() == 3
    assert len(calls) == 1


def test_an_existing_table_is_never_overwritten(spark, tmp_path):
    def other(s):
        return s.createDataFrame([("z", 9.0)], "unit string, y double")

    csv = tmp_path / "index.csv"
    csv.write_text("unit,y\na,1.5\nb,NA\n")
    assert [tuple(r) for r in src.load_or_build(spark, str(csv), other).collect()] == [("a", 1.5), ("b", None)]
    assert csv.read_text() == "unit,y\na,1.5\nb,NA\n"
    folder = tmp_path / "unmarked"
    spark.range(3).write.parquet(str(folder))
    (folder / "_SUCCESS").unlink()
    (folder / "._SUCCESS.crc").unlink(missing_ok=True)
    assert src.load_or_build(spark, str(folder), other).count() == 3


@pytest.fixture(scope="module")
def result(spark):
    from tests.conftest import rows_of

    d = walks(4, 40, 7)
    d["T"] = [v + 1 + 0.1 * (i % 3) for i, v in enumerate(d["d1"])]
    panel = spark.createDataFrame(rows_of(d), "outcome string, unit string, t date, y double")
    outs = spark.createDataFrame(
        [("x", month(30), None, None)],
        "outcome string, treatment_date date, start_date date, end_date date",
    )
    return estimate(panel, ["T"], ["d0", "d1", "d2", "d3"], outs, shifts=[0, 5], compute_ci=True)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_results_survive_a_round_trip(spark, result, tmp_path, fmt):
    paths = result.save(str(tmp_path), fmt)
    again = result.save(str(tmp_path), fmt)
    assert paths == again
    back = src.read_results(spark, paths["series"], src.STORED_SERIES, fmt)
    want = {tuple(r) for r in result.series.collect()}
    assert {tuple(r) for r in back.select(*result.series.columns).collect()} == want
    assert back.select("ci_step").distinct().collect()[0][0] == 0.1
    for kind, schema, table in (
        ("weights", src.WEIGHTS_SCHEMA, result.weights),
        ("inference", src.STORED_TTEST, result.inference),
    ):
        stored = src.read_results(spark, paths[kind], schema, fmt).select(*table.columns)
        assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in table.collect()}


def test_a_run_replaces_only_its_own_partitions(spark, result, tmp_path):
    from counterpanel.sources import sinks

    base = str(tmp_path)
    sinks.save_series(result.series, base, 0.1)
    sinks.save_series(result.series.filter("placebo = 'time_5'"), base, 0.1)
    assert spark.read.parquet(f"{base}/series").count() == result.series.count()


def test_result_schemas(result):
    assert result.series.columns == [f.name for f in src.SERIES_SCHEMA]
    assert result.inference.columns == [f.name for f in src.TTEST_SCHEMA]
    assert result.weights.columns == [f.name for f in src.WEIGHTS_SCHEMA]
    assert [f.dataType for f in result.series.schema] == [f.dataType for f in src.SERIES_SCHEMA]


def test_yearly_rates(spark):
    rows = [(month(i), 100.0 + i, 200.0 + i, "x", "T", "FALSE") for i in range(30) if i != 3]
    df = spark.createDataFrame(
        rows, "date date, obs double, synth double, outcome string, treated string, placebo string"
    )
    out = {r["date"]: r for r in rates.year_on_year(df, ["x"], str(month(14)), 12).collect()}
    assert max(out) == month(26) and out[month(5)]["obs_rate"] is None
    assert out[month(15)]["obs_rate"] is None  # its base month is missing
    at, after = out[month(14)], out[month(16)]
    assert at["synth_rate"] == at["obs_rate"] == pytest.approx(100 * 12 / 102)
    assert after["synth_rate"] == pytest.approx(100 * (216 - 104) / 104)
    assert after["gaps_rate"] == pytest.approx(after["obs_rate"] - after["synth_rate"])


def test_report_frame(spark, result):
    labels = spark.createDataFrame([("T", "Tland", "T", "SC_t")], "unit string, label string, obs_key string, synth_key string")
    real = result.series.filter("placebo = 'FALSE'")
    report.check_report_input(real, "x", True)
    frame = report.report_frame(real, labels)
    assert frame.count() == 3 * 40
    lines = {(r["series"], r["subplot"], r["color"], r["color_ord"]) for r in frame.collect()}
    assert lines == {("Observed", "x", "T", 1), ("Synthetic", "x", "SC_t", 2), ("Difference", "Difference", "Gap", 3)}
    bounded = frame.filter("lower_ci IS NOT NULL")
    assert bounded.count() == 10 and bounded.filter("series <> 'Difference'").isEmpty()
    assert report.report_frame(real, labels, with_ci=False).filter("lower_ci IS NOT NULL").isEmpty()
    study = spark.createDataFrame([("x", "T", "FALSE", month(30))], "outcome string, treated string, placebo string, treatment_date date")
    marker = report.treatment_marker(real, study)
    row = marker.first()
    assert row["marker"] == row["treatment_date"] == month(30)
    assert report.ci_band(frame, marker).count() == 10
    assert report.zero_lines(frame).count() == 2


def test_report_input_errors(spark, result):
    with pytest.raises(ValueError, match="missing columns: obs, synth"):
        report.check_report_input(result.series.drop("obs", "synth"), "x", False)
    with pytest.raises(ValueError, match="missing columns for bounds: upper_ci"):
        report.check_report_input(result.series.drop("upper_ci"), "x", True)
    with pytest.raises(ValueError, match="holds no value"):
        report.check_report_input(result.series.withColumn("upper_ci", F.lit(None).cast("double")), "x", True)
    with pytest.raises(ValueError, match="outcome 'z' does not occur"):
        report.check_report_input(result.series, "z", False)


def test_checks(spark):
    asked = spark.createDataFrame([(0.0,), (70.0,), (71.0,), (-1.0,), (1.5,), (None,), (float("nan"),)], "placebo_shift double")
    got = [r["reason"] for r in checks.check_studies(asked).collect()]
    assert got == [None, None, "shift_out_of_range", "shift_out_of_range", "shift_not_integer", "shift_not_integer", "shift_not_integer"]
    assert checks.unsupported_message(["a", "b"], "c") == "Outcomes not in the panel: a, b. It holds: c"
    empty = spark.createDataFrame([(1.0, float("nan")), (None, None)], "a double, b double")
    assert {tuple(r) for r in checks.all_null_columns(empty, ["a", "b"]).collect()} == {("a", 1, False), ("b", 0, True)}
