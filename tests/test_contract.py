"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = (
    "check_studies",
    "unsupported_outcomes",
    "shift_months",
    "drop_units_with_nulls",
    "window_lengths",
    "gram_matrix",
    "sc_weights_two_donor",
    "sc_weights_certificate",
    "placebo_att_two_donor",
    "conformal_block_two_donor",
    "conformal_iid_uniform",
    "conformal_ci_two_donor",
    "series_table",
    "yoy_rate_synth",
    "report_frame",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 54


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
