"""The domain tables expressed over the star-schema tables used for checking.

Every table is derived by Spark from the given parquet files; the matching SQL text lives in
``netreach.registry.sqltables``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netreach.plans.staging import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _county(c: str):
    return F.lpad(F.col(c).cast("string"), 5, "0")


def _site(c: str):
    return F.col(c).cast("string")


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    line = spread(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate"
    ))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    buyers = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")  # so that lines are shuffled once
    return (
        line.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("day"),
            F.when(F.col("l_linestatus") == "F", "Destination").otherwise("Origin").alias("direction"),
            _site("l_suppkey").alias("site"),
            _county("c_nationkey").alias("county"),
            F.concat(_county("c_nationkey"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("bg"),
            F.col("l_quantity").alias("volume"),
            (F.lit(1) + F.col("c_custkey") % 97).cast("double").alias("area"),
            F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("population"),
        )
    )


def daily_od(spark: SparkSession, sf: str) -> DataFrame:
    """Daily trip records in the layout of the daily files."""
    t = _trips(spark, sf).groupBy("day", "direction", "site", "county").agg(
        F.sum("volume").alias("volume"), F.sum("area").alias("area"), F.sum("population").alias("population")
    )
    return t.select(
        "day",
        "direction",
        F.when(F.col("direction") == "Origin", F.col("site")).alias("sewershed_o"),
        F.when(F.col("direction") == "Destination", F.col("site")).alias("sewershed_d"),
        "county",
        "volume",
        "area",
        "population",
    )


def weekly_edges(spark: SparkSession, sf: str) -> DataFrame:
    from netreach.operators.od import weekly_od

    return weekly_od(daily_od(spark, sf))


def bg_links(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly fine-area links in both directions."""
    return (
        _trips(spark, sf)
        .groupBy(
            F.date_trunc("week", "day").cast("date").alias("week"),
            "direction",
            F.col("bg").alias("bg_fips"),
            F.col("site").alias("wwtp"),
        )
        .agg(
            F.sum("volume").alias("volume"),
            F.max("area").alias("area"),
            F.max("population").alias("population"),
        )
    )


def clinical(spark: SparkSession, sf: str) -> DataFrame:
    """Clinical line list: one county-level record per order."""
    orders = table(spark, sf, "orders")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("County").alias("region_level"),
        _county("c_nationkey").alias("region"),
        F.element_at(
            F.create_map(
                F.lit("1"), F.lit("SARS-CoV-2"),
                F.lit("2"), F.lit("Flu"),
                F.lit("3"), F.lit("RSV"),
            ),
            F.substring("o_orderpriority", 1, 1),
        ).alias("pathogen"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("c_mktsegment").alias("age_group"),
        F.lit(1.0).alias("cases"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("hospitalized"),
    )


def site_clinical(spark: SparkSession, sf: str) -> DataFrame:
    """Clinical records at site level: one record per line, hospitalized when returned."""
    return table(spark, sf, "lineitem").select(
        F.lit("Sewershed").alias("region_level"),
        _site("l_suppkey").alias("region"),
        F.when(F.col("l_returnflag") == "R", "COVID").when(F.col("l_returnflag") == "A", "Influenza")
        .otherwise("RSV").alias("pathogen"),
        F.col("l_shipdate").cast("date").alias("event_date"),
        F.lit(1.0).alias("cases"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("hospitalized"),
    )


def population(spark: SparkSession, sf: str) -> DataFrame:
    """County population: a thousand persons per customer."""
    return (
        table(spark, sf, "customer")
        .groupBy(_county("c_nationkey").alias("county_fips"))
        .agg((F.count(F.lit(1)) * 1000.0).alias("population"))
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate sites with plane coordinates in km."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        _site("s_suppkey").alias("wwtp"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("pop_served"),
        ((k * 7919) % 1000).cast("double").alias("x"),
        ((k * 104729) % 1000).cast("double").alias("y"),
        (F.lit(20) + k % 60).cast("double").alias("radius"),
        F.when(k % 5 == 0, "sentinel surveillance site").otherwise("candidate").alias("act_sts"),
        _county("s_nationkey").alias("county_fips"),
        k.alias("ord"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Contribution score per site: returned sales."""
    return (
        table(spark, sf, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .groupBy(_site("l_suppkey").alias("wwtp"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly sales per county node."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.date_trunc("week", "l_shipdate").cast("date").alias("week"),
            F.concat(F.lit("C_"), _county("c_nationkey")).alias("node"),
        )
        .agg(F.round(F.sum("l_extendedprice") / 1000, 2).alias("x"))
    )


def _square(x: Column, y: Column, h: Column) -> Column:
    corner = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return F.array(*[F.struct((x + a * h).alias("x"), (y + b * h).alias("y")) for a, b in corner])


def site_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Square service area around every site."""
    h = F.col("radius") / 2 + 0.25
    return sites(spark, sf).withColumn("ring", _square(F.col("x"), F.col("y"), h))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Square fine areas with population, one per customer."""
    k = F.col("c_custkey")
    h = F.lit(3.25) + k % 5
    x, y = ((k * 7919) % 1000).cast("double"), ((k * 104729) % 1000).cast("double")
    return table(spark, sf, "customer").select(
        F.concat(_county("c_nationkey"), F.lpad(k.cast("string"), 7, "0")).alias("area_id"),
        _county("c_nationkey").alias("county_fips"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("population"),
        (4 * h * h).alias("area"), x.alias("x"), y.alias("y"), _square(x, y, h).alias("ring"),
    )


def county_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Square county tiles of 200 km with an off-centre representative point."""
    k = F.col("n_nationkey")
    x = ((k % 5) * 200 + 99.5).cast("double")
    y = (F.floor(k / 5) * 200 + 99.5).cast("double")
    return table(spark, sf, "nation").select(
        _county("n_nationkey").alias("county_fips"), F.concat("n_name", F.lit(" County")).alias("county_name"),
        (x + (k * 7) % 90).alias("x"), y.alias("y"), _square(x, y, F.lit(100.0)).alias("ring"),
        k.alias("k"),
    )


def cbsa_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Square census areas inside the county tiles, growing with the county number."""
    k = F.col("n_nationkey")
    x = ((k % 5) * 200 + 99.5).cast("double")
    y = (F.floor(k / 5) * 200 + 99.5).cast("double")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("cb"), _county("n_nationkey")).alias("cbsa"), F.concat(F.lit("area "), "n_name").alias("name"),
        F.concat(F.lit("M"), (k % 3 + 1).cast("string")).alias("lsad"), _square(x, y, F.lit(25.0) + 3 * k).alias("ring"),
    )
