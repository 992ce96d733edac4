"""What a request reads, many treated units, several dates, versions, one builder."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpanel import estimate
from counterpanel.operators import study as st
from counterpanel.plans.estimate import requested_rows
from counterpanel.sources import tables as src, versions
from tests.conftest import month, rows_of

PANEL = "outcome string, unit string, t date, y double"
REQUEST = "outcome string, treatment_date date, start_date date, end_date date"


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(4)
    out = {f"d{i}": list(rng.normal(size=36).cumsum()) for i in range(4)}
    for k in range(3):
        out[f"T{k}"] = list(np.array(out["d1"]) + rng.normal(size=36))
    return out


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_an_outcome_not_asked_for_is_neither_read_nor_checked(spark, walks, tmp_path):
    names = ["d0", "d1", "d2", "d3"]
    panel = spark.createDataFrame(rows_of(walks) + 2 * rows_of(walks, "other"), PANEL)
    path = f"file://{tmp_path}/panel"
    panel.write.partitionBy("outcome").parquet(path)
    stored = spark.read.parquet(path)
    request = spark.createDataFrame([("x", month(24), month(2), month(33)), ("x", month(20), month(1), month(30))], REQUEST)
    rows = requested_rows(stored.select("outcome", "unit", "t", "y"), request)
    assert "dynamicpruning" in plan_of(rows)
    span = rows.agg(F.min("t"), F.max("t"), F.countDistinct("outcome")).first()
    assert tuple(span) == (month(1), month(33), 1)
    whole = requested_rows(stored.select("outcome", "unit", "t", "y"), request, ["x"])
    assert whole.count() == 36 * len(walks)
    out = estimate(stored, ["T0"], names, request)
    assert out.inference.count() == 2
    with pytest.raises(ValueError, match="not unique"):
        estimate(stored, ["T0"], names, request.withColumn("outcome", F.lit("other")))


def test_two_dates_of_one_outcome_stay_apart(spark, walks):
    request = spark.createDataFrame([("x", month(d), None, None) for d in (20, 26)], REQUEST)
    out = estimate(spark.createDataFrame(rows_of(walks), PANEL), ["T0", "T1"], ["d0", "d1"], request)
    keys = ["outcome", "treated", "placebo", "treatment_date"]
    assert out.series.groupBy(*keys, "date").count().filter("count > 1").isEmpty()
    assert {(r["treated"], r["treatment_date"], r["T0"]) for r in out.inference.collect()} == {
        (u, month(d), d) for u in ("T0", "T1") for d in (20, 26)
    }


def test_treated_units_as_a_table(spark, walks):
    panel = spark.createDataFrame(rows_of(walks), PANEL)
    request = spark.createDataFrame([("x", month(26), None, None)], REQUEST)
    units = ["T0", "T1", "T2"]
    table = spark.createDataFrame([(u,) for u in [*units, "T1"]], "unit string")
    a = estimate(panel, units, ["d0", "d1", "d2"], request, shifts=[0, 4])
    b = estimate(panel, table, ["d0", "d1", "d2"], request, shifts=[0, 4])
    for x, y in ((a.inference, b.inference), (a.weights, b.weights), (a.series, b.series)):
        one, two = (
            sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in t.select(*x.columns[::-1]).collect())
            for t in (x, y)
        )
        assert one == two


def test_plan_does_not_grow_with_treated_units(spark):
    request = spark.createDataFrame([("x", month(26), None, None)], REQUEST)
    sizes, studies = [], []
    for n in (100, 100_000):
        study = st.expand_studies(request, spark.range(n).select(F.concat(F.lit("u"), "id").alias("unit")), [0, 4])
        sizes.append(len(plan_of(study)))
        studies.append(study.agg(F.countDistinct("study_id"), F.countDistinct("batch_id")).first())
    assert abs(sizes[0] - sizes[1]) < 50
    assert tuple(studies[1])[0] == 200_000 and tuple(studies[0]) == (200, 4)
    # a batch holds a bounded number of treated units
    assert studies[1][1] >= 2 * 100_000 / 64


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_versions_are_whole_or_absent(spark, walks, tmp_path, monkeypatch, fmt):
    base = f"file://{tmp_path}/out"
    panel = spark.createDataFrame(rows_of(walks), PANEL)
    request = spark.createDataFrame([("x", month(26), None, None)], REQUEST)
    first = estimate(panel, ["T0"], ["d0", "d1", "d2"], request, shifts=[0, 30], compute_ci=True)
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, base)
    name = first.save_version(base, fmt)
    for kind, table in (("series", first.series), ("inference", first.inference), ("weights", first.weights), ("bands", first.bands), ("rejected", first.rejected)):
        stored = versions.read_version(spark, base)[kind].select(*table.columns)
        assert stored.dtypes == table.dtypes and stored.count() > 0
        assert sorted(map(str, stored.collect())) == sorted(map(str, table.collect())), kind

    second = estimate(panel, ["T1"], ["d0", "d1", "d2"], request)
    whole, read = versions._read, []

    def dies(*args):  # after the second table
        read.append(args[3])
        if len(read) == 2:
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(versions, "_read", dies)
    with pytest.raises(RuntimeError, match="lost"):
        second.save_version(base, fmt)
    monkeypatch.undo()
    assert versions.committed_versions(spark, base) == [name]
    assert {r["treated"] for r in versions.read_version(spark, base)["series"].collect()} == {"T0"}
    later = second.save_version(base, fmt)
    assert versions.committed_versions(spark, base) == [name, later]
    assert {r["treated"] for r in versions.read_version(spark, base)["series"].collect()} == {"T1"}
    assert {r["treated"] for r in versions.read_version(spark, base, name)["series"].collect()} == {"T0"}


def test_one_of_several_builders_builds(spark, tmp_path):
    calls, found = [], []

    def build(session):
        calls.append(1)
        return session.range(200).selectExpr("id", "CAST(id / 2 AS DOUBLE) AS half", "IF(id = 3, NULL, 'a') AS name")

    path = f"file://{tmp_path}/index.csv"
    threads = [threading.Thread(target=lambda: found.append(src.load_or_build(spark, path, build).count())) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [200] * 4 and len(calls) == 1
    again = src.load_or_build(spark, path, build)
    assert len(calls) == 1 and again.dtypes == [("id", "bigint"), ("half", "double"), ("name", "string")]
    assert again.filter("name IS NULL").count() == 1
    # a claim that nobody works on is named
    (tmp_path / "other.claim").write_text("")
    with pytest.raises(TimeoutError, match="other.claim"):
        src.load_or_build(spark, f"file://{tmp_path}/other", build, wait_seconds=0.5)
