import datetime as dt

from netreach.operators import od
from netreach.sources import readers
from netreach.streaming import weekly


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = "direction,Sewershed-O,Sewershed-D,County,Volume,Area,Population\n"
    for i in range(30):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        (src / f"od_{day:%Y%m%d}.csv").write_text(head + f"Destination,,a,8001,{i},1,5\nOrigin,b,,8003,{i * 2},2,\n")
    weekly.run_weekly(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), late="0 seconds").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {tuple(r) for r in od.weekly_od(readers.read_daily_od(spark, str(src))).collect()}
    rows = {tuple(r) for r in got.select(*od.EDGE_KEY, *od.MEASURES).collect()}
    assert rows <= want and len({r[0] for r in rows}) == 4  # the last week is still open
