from __future__ import annotations

import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(i: int) -> date:
    return date(2010 + i // 12, i % 12 + 1, 1)


def rows_of(series: dict[str, list], outcome: str = "x") -> list[tuple]:
    """(outcome, unit, t, y) rows; the string 'absent' leaves a cell out."""
    return [
        (outcome, unit, month(i), None if y is None else float(y))
        for unit, values in series.items()
        for i, y in enumerate(values)
        if not isinstance(y, str)
    ]


@pytest.fixture
def make_panel(spark):
    def build(series: dict[str, list], outcome: str = "x"):
        return spark.createDataFrame(
            rows_of(series, outcome), "outcome string, unit string, t date, y double"
        )

    return build


@pytest.fixture
def outcomes(spark):
    def build(t0: int, names=("x",)):
        return spark.createDataFrame(
            [(n, month(t0), None, None) for n in names],
            "outcome string, treatment_date date, start_date date, end_date date",
        )

    return build
