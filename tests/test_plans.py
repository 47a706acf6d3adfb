"""Ordered prefixes, quantiles and products against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netreach.plans import ordering, sparse


def frame(spark, n=400, seed=3):
    r = random.Random(seed)
    # one value and one group hold a third of all rows
    rows = [(i, "g0" if r.random() < 0.4 else f"g{r.randrange(5)}", 7.0 if r.random() < 0.34 else float(r.randrange(60))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, v double")


def test_number_rows_and_sums(spark):
    rows, df = frame(spark)
    got = {r.id: (r.n, r.s) for r in ordering.running_sums(
        df, ["g"], [-F.col("v"), F.col("id")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    for g in {r[1] for r in rows}:
        total = 0.0
        for k, (i, _, v) in enumerate(sorted([r for r in rows if r[1] == g], key=lambda r: (-r[2], r[0])), 1):
            total += v
            assert got[i][0] == k and got[i][1] == pytest.approx(total)


@pytest.mark.parametrize("average", [False, True])
def test_rank_ties(spark, average):
    rows, df = frame(spark)
    df = df.unionByName(spark.createDataFrame([(9999, "g0", None)], df.schema))
    got = {r.id: r.k for r in ordering.competition_rank(df, ["g"], "v", "k", ascending=False, average=average).collect()}
    assert got.pop(9999) is None
    for i, g, v in rows:
        above = sum(1 for r in rows if r[1] == g and r[2] > v)
        same = sum(1 for r in rows if r[1] == g and r[2] == v)
        assert got[i] == above + 1 + ((same - 1) / 2 if average else 0)


def test_exact_quantiles(spark):
    rows, df = frame(spark)
    q = ordering.exact_quantiles(df, [], "v", {"a": 0.01, "b": 0.75, "c": 1.0}).first()
    assert (q.a, q.b, q.c) == pytest.approx(tuple(np.quantile([r[2] for r in rows], [0.01, 0.75, 1.0])))
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert ordering.exact_quantiles(four, [], "v", {"q": 0.75}).first().q == 3.25


def test_product_with_hub(spark):
    r = random.Random(5)
    a = np.array([[r.choice([0, 0, 1.5, 2]) for _ in range(9)] for _ in range(9)])
    a[:, 4] = 1.0  # every row meets node 4
    edges = [(f"n{i}", f"n{j}", float(a[i, j])) for i in range(9) for j in range(9) if a[i, j]]
    e = spark.createDataFrame(edges, "src string, dst string, w double")
    got = {(x.src, x.dst): x.w for x in sparse.product(e, e).collect()}
    want = a @ a
    for i in range(9):
        for j in range(9):
            assert got.get((f"n{i}", f"n{j}"), 0.0) == pytest.approx(want[i, j])
