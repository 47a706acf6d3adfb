"""Order-dependent results over whole tables without a single-partition window.

A global window puts every row into one task.  Here rows are dealt to range partitions of
(group, sort key), which finds a row's range by binary search among sampled cuts, each range
is ordered on its own, and the range totals, a row per group and range, give the offsets.
The cuts only decide who does the work: any cuts give the same, exact answer.

``order`` is a list of ascending, non-null expressions that together identify a row; negate
a number to sort it descending.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.plans.staging import stage


def _bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null meeting null; the keys stay once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _bucketed(df: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
    """Rows with their sort key and range, staged, as ranges drawn anew could differ."""
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    ranges = keyed.repartitionByRange(_bucket_count(df), *parts, "_key")
    return stage(ranges.withColumn("_bkt", F.spark_partition_id()))


def _bucketed_offsets(rows: DataFrame, parts: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows plus, per entry of ``sums``, the total over all earlier ranges."""
    totals = rows.groupBy(*parts, "_bkt").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts,
        "_bkt",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    return _join_null_safe(rows, offsets, [*parts, "_bkt"])


def running_sums(
    df: DataFrame, parts: list[str], order: list[Column], sums: dict[str, Column], staged: bool = False
) -> DataFrame:
    """Add inclusive running sums, named by the keys of ``sums``.

    The input is read twice (cuts, ranges), so it is staged first unless the caller already did.
    """
    df = df if staged else stage(df)
    rows = _bucketed_offsets(_bucketed(df, parts, order), parts, sums)
    w = (
        Window.partitionBy(*parts, "_bkt")
        .orderBy("_key")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = rows.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_o_{k}")).alias(k)
            for k, c in sums.items()
        ],
    )
    return out


def number_rows(
    df: DataFrame, parts: list[str], order: list[Column], name: str, staged: bool = False
) -> DataFrame:
    """``row_number`` over (parts, order), exact, with hot groups split over tasks."""
    return running_sums(df, parts, order, {name: F.lit(1).cast("long")}, staged)


def value_positions(df: DataFrame, parts: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values with their count, last ascending position and group size.

    Equal values are folded by partial aggregation first, so a value that a third of all
    rows share is one row here; only the folded table is staged.  A row counts ``weight`` times.
    """
    dist = stage(
        df.filter(F.col(value).isNotNull())
        .groupBy(*parts, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    )
    total = dist.groupBy(*parts).agg(F.sum("_n").alias("_total"))
    pos = running_sums(dist, parts, [F.col(value)], {"_hi": F.col("_n")}, staged=True)
    return pos.join(total, parts) if parts else pos.crossJoin(F.broadcast(total))


def competition_rank(
    df: DataFrame, parts: list[str], value: str, name: str, ascending: bool = True,
    average: bool = False,
) -> DataFrame:
    """Rank with shared minimum (or average) for ties; null values keep a null rank."""
    signed = df.withColumn("_v", F.col(value) if ascending else -F.col(value))
    pos = value_positions(signed.select(*parts, "_v"), parts, "_v")
    first = F.col("_hi") - F.col("_n") + 1
    rank = first + (F.col("_n") - 1) / 2 if average else first
    ranked = pos.select(*[F.col(p).alias(f"_p_{p}") for p in parts], F.col("_v").alias("_pv"),
                        rank.alias(name))
    on = [F.col(p) == F.col(f"_p_{p}") for p in parts] + [F.col("_v") == F.col("_pv")]
    return signed.join(ranked, reduce(lambda a, b: a & b, on), "left").select(*df.columns, name)


def exact_quantiles(
    df: DataFrame, parts: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group; one column per entry of ``probs``.  A row counts ``weight`` times."""
    pos = value_positions(df, parts, value, weight)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)

        def pick(k: Column) -> Column:
            return F.max(F.when((F.col("_hi") - F.col("_n") <= k) & (k < F.col("_hi")), F.col(value)))

        aggs += [
            pick(F.floor(at)).alias(f"_a_{name}"),
            pick(F.ceil(at)).alias(f"_b_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
    out = pos.groupBy(*parts).agg(*aggs)
    return out.select(
        *parts,
        *[
            (F.col(f"_a_{k}") + (F.col(f"_b_{k}") - F.col(f"_a_{k}")) * F.col(f"_f_{k}")).alias(k)
            for k in probs
        ],
    )


def top_rows(df: DataFrame, order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows in ``order`` (TakeOrdered), optionally numbered from 1.

    Only the ``n`` kept rows reach the numbering window.
    """
    head = df.orderBy(*order).limit(n)
    if name is None:
        return head
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)))
