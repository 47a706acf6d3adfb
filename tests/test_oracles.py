"""Registered queries against their SQL twins on the smallest tables.

A set that covers every shared table of the twins; NETREACH_ALL=1 runs all of them.
"""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from netreach.registry import catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def covering() -> list[str]:
    """Twins that together read every shared SQL table, the shortest first; a changed table reruns one at the least."""
    reads = {name: set(re.findall(r"\bfx_\w+", sql)) for name, sql in catalog.ORACLES.items()}
    open_, chosen = set().union(*reads.values()), []
    while open_:
        best = min(reads, key=lambda name: (-len(reads[name] & open_), len(catalog.ORACLES[name]), name))
        chosen.append(best)
        open_ -= reads[best]
    return sorted(chosen)


#: Twins that read the tables themselves.
PLAIN = ["A5_ensure_outflow", "S1_read_daily_od", "N1_site_edges", "N3_nearest_other", "Q2_reconcile", "F3_add_period_fields", "V3_union_coverage_prob_union"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("NETREACH_ALL") else sorted({*covering(), *PLAIN})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def rows(df, cols):
    # whole numbers with nulls arrive as doubles on one side
    df = df[cols].apply(lambda c: c.astype("Int64") if c.isna().any() and c.dtype == float and (c.dropna() % 1 == 0).all() else c)
    df = df.astype(object).where(df.notna(), None)
    return sorted(tuple(str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
