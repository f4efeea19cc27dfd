"""Every registered query against its SQL, on the whole test tables."""

import os

import pytest

import __spark_entry__ as entry_point
import oracle
from shoplens import catalog

SF_DIR = f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, SF_DIR, entry_point.queries()[name], entry_point.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 7


@pytest.mark.parametrize(
    "name",
    ["attribute", "before_parent", "cube_category", "margin_by_category_recognized", "outside_window",
     "refund_exceeds_line", "refund_exceeds_order", "roas_first", "rfm", "channel_efficiency"],
)
def test_matches_sql_without_broadcast(spark, con, name):
    """The same queries when nothing may be broadcast, as with large dimensions."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert oracle.compare(spark, con, SF_DIR, entry_point.queries()[name], entry_point.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
