"""Every registered query against its SQL twin on the smallest tables."""

import pathlib

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from wattsift.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="needs the given tables")

ROWS_ONLY = {"a25_distinct_prompts_approx", "s10_write_summary_json"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow()
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert name in ROWS_ONLY and got.num_rows > 0
    else:
        assert difference(got, duck.sql(twin).to_arrow_table()) is None


def test_flagship(spark):
    assert entry.entry(spark).columns == [
        "platform", "latency_ratio", "energy_pct_of_base", "quality_diff", "lpw_ratio",
    ]
