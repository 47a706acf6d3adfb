"""F8 and its SQL when the customer numbers outgrow five digits."""
import duckdb

import __spark_entry__ as entry


def test_commute_distance_of_long_ids(spark, tmp_path):
    keys = [0, 1, 2, 3, 90_000, 90_001, 100_001, 100_003, 899_999]
    spark.createDataFrame([(k, k % 15) for k in keys], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = entry.queries()["F8_commute_distance"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["F8_commute_distance"])
    names = [d[0] for d in want.description]
    key = lambda r: tuple("~" if v is None else str(v) for v in r)
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.fetchall()))
