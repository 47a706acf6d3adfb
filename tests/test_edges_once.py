"""Queries that rank by risk build the weekly edges once for coverage and risk."""
import pytest

from netreach.registry import catalog
from netreach.sources import driver_tables


@pytest.mark.parametrize("query", ["K2_month_rank_table_risk", "X1_select_sites_risk"])
def test_edges_are_built_once(spark, monkeypatch, query):
    """Lines were joined and shuffled anew for coverage and for risk, and all of it lay on the disks."""
    built, edges = [], driver_tables.weekly_edges
    monkeypatch.setattr(driver_tables, "weekly_edges", lambda *a: built.append(a) or edges(*a))
    assert catalog.QUERIES[query](spark, "/root/testdata/sf0.001").columns
    assert len(built) == 1
