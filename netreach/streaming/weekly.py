"""Weekly means and site totals kept up to date while daily files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netreach.operators.od import INBOUND, MEASURES, OUTBOUND
from netreach.plans.staging import scratch_path
from netreach.sources import schemas
from netreach.sources.readers import parse_daily_od


def daily_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Daily CSV files as a stream, in the same typed layout as the batch reader."""
    raw = (
        spark.readStream.schema(schemas.DAILY_OD).option("header", True).option("maxFilesPerTrigger", files_per_trigger)
        .csv(path).select("*", F.col("_metadata.file_path").alias("path"))
    )
    return parse_daily_od(raw)


def weekly_od_stream(daily: DataFrame, late: str = "14 days") -> DataFrame:
    """Mean of the daily records per Monday week and edge; a week closes after the watermark."""
    dest = F.lower("direction") == "destination"
    rows = daily.select(
        F.col("day").cast("timestamp").alias("at"),
        F.when(dest, INBOUND).when(F.lower("direction") == "origin", OUTBOUND).alias("direction"),
        F.when(dest, F.col("sewershed_d")).otherwise(F.col("sewershed_o")).alias("wwtp"),
        F.col("county").alias("county_fips"), *MEASURES,
    ).filter(F.col("direction").isNotNull() & F.col("wwtp").isNotNull() & F.col("county_fips").isNotNull())
    week = F.window("at", "7 days", "7 days", "4 days")  # windows counted from a Thursday start on Mondays
    return (
        rows.withWatermark("at", late).groupBy(week.alias("w"), "direction", "wwtp", "county_fips")
        .agg(*[F.avg(m).alias(m) for m in MEASURES])
        .select(F.col("w.start").cast("date").alias("week"), "direction", "wwtp", "county_fips", *MEASURES)
    )


def run_weekly(spark: SparkSession, path: str, out: str, checkpoint: str | None = None, late: str = "14 days") -> StreamingQuery:
    """Append closed weeks to a Parquet table, exactly once, until the folder is read."""
    return (
        weekly_od_stream(daily_stream(spark, path), late).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint or scratch_path(spark, "weekly_stream"))
        .trigger(availableNow=True).start()
    )
