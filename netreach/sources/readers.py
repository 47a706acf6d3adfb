"""Readers: explicit schemas, name resolution on the driver, canonical keys, null-safe casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from netreach.functions.expr import num
from netreach.functions.keys import canon_area, canon_county, canon_site, norm_region_level, strip_county_suffix
from netreach.functions.losses import observed
from netreach.functions.periods import in_window
from netreach.sources import schemas


def resolve_column(df: DataFrame, candidates: list[str], required: bool = True, exact: bool = False) -> str | None:
    """First exact case-insensitive match, then the first column containing a candidate."""
    lower = {c.strip().lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    if not exact:
        for c in candidates:
            for name, original in lower.items():
                if c.lower() in name:
                    return original
    if required:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return None


def resolve_columns(df: DataFrame, spec: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """Select and rename by ``{target: candidates}``; optional targets without a match are left out."""
    found = {t: resolve_column(df, names, t not in optional) for t, names in spec.items()}
    return df.select(*[F.col(f"`{c}`").alias(t) for t, c in found.items() if c is not None])


def numeric_hint_column(df: DataFrame, hints: list[str]) -> str:
    """First numeric column whose name carries a hint, else the first numeric column."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    for name in numeric:
        if any(h in name.lower() for h in hints):
            return name
    if not numeric:
        raise ValueError(f"no numeric column in {df.columns}")
    return numeric[0]


def date_from_path(path: Column) -> Column:
    """Date in the last ``_`` token of the file name, or of the folder the file is in."""
    stamp = F.regexp_extract(path, r"_(\d{8})(?:\.[A-Za-z]+)*(?:/[^/]*)?$", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd")).cast("date")


def parse_daily_od(raw: DataFrame, path: str = "path", losses: Observation | None = None) -> DataFrame:
    """Typed daily records; rows of files without a readable date are dropped.

    ``losses`` counts rows without a date, which are dropped, and of the others those with an unreadable volume.
    """
    typed = raw.select(
        date_from_path(F.col(path)).alias("day"), "direction",
        canon_site("Sewershed-O").alias("sewershed_o"), canon_site("Sewershed-D").alias("sewershed_d"),
        canon_county("County").alias("county"),
        num("Volume").alias("volume"), num("Area").alias("area"), num("Population").alias("population"), F.col("Volume").alias("_volume"),
    )
    no_day = F.col("day").isNull()
    typed = observed(typed, losses, undated=no_day, unread_volume=~no_day & F.col("volume").isNull() & F.col("_volume").isNotNull())
    return typed.filter(~no_day).drop("_volume")


def read_daily_od(spark: SparkSession, path: str, losses: Observation | None = None) -> DataFrame:
    """All daily CSV files below ``path``."""
    raw = (
        spark.read.schema(schemas.DAILY_OD).option("header", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
        .csv(path).select("*", F.col("_metadata.file_path").alias("path"))
    )
    return parse_daily_od(raw, losses=losses)


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """Files left out because their name carries no date, with their row counts."""
    raw = spark.read.schema(schemas.DAILY_OD).option("header", True).option("recursiveFileLookup", True).csv(path)
    p = raw.select(F.col("_metadata.file_path").alias("path"))
    return p.filter(date_from_path(F.col("path")).isNull()).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def write_weekly_edges(edges: DataFrame, path: str, rows_in_file: int = 5_000_000) -> None:
    """Weekly edge list partitioned by week, sorted by direction inside the files.

    One shuffle by week and a hash of the edge, split so far that a task writes about ``rows_in_file`` rows of a week.
    """
    most = edges.groupBy("week").count().agg(F.max("count")).first()[0] or 0
    split = F.pmod(F.xxhash64("wwtp", "county_fips"), F.lit(most // rows_in_file + 1))
    edges.repartition("week", split).sortWithinPartitions("week", "direction").write.mode("overwrite").partitionBy("week").parquet(path)


def read_weekly_edges(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Weekly edges in an inclusive window; only the partitions of the window are opened."""
    df = spark.read.schema(schemas.WEEKLY_EDGES).parquet(path)
    return weekly_edges(df, start, end)


def weekly_edges(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Checked and typed weekly edges; missing area or population columns become null."""
    need = {"week", "direction", "wwtp", "county_fips", "volume"}
    missing = need - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    for c in ("area", "population"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return in_window(df, start, end).select(
        "week", "direction", canon_site("wwtp", squeeze=True).alias("wwtp"), canon_county("county_fips").alias("county_fips"),
        num("volume").alias("volume"), num("area").alias("area"), num("population").alias("population"))


def union_directions(inbound: DataFrame, outbound: DataFrame) -> DataFrame:
    """Inbound and outbound weekly tables as one, tolerating missing measure columns."""
    from netreach.operators.od import INBOUND, OUTBOUND

    return inbound.withColumn("direction", F.lit(INBOUND)).unionByName(
        outbound.withColumn("direction", F.lit(OUTBOUND)), allowMissingColumns=True)


def assert_not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def bg_links(df: DataFrame, direction: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fine-area links of one direction with canonical keys; null measures become 0."""
    out = in_window(df, start, end).filter(F.lower("direction") == direction.lower())
    return out.select(
        "week", "direction", canon_area("bg_fips").alias("bg_fips"), canon_site("wwtp").alias("wwtp"),
        *[F.coalesce(num(c), F.lit(0.0)).alias(c) for c in ("volume", "area", "population")])


def read_bg_links(spark: SparkSession, path: str, direction: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return bg_links(spark.read.schema(schemas.BG_LINK).parquet(path), direction, start, end)


#: The column names and date formats of clinical files.
CLINICAL_COLUMNS = {
    "region_level": ["Region Level"], "region": ["Region Name", "Region"], "pathogen": ["Pathogen Name", "Pathogen"],
    "event_date": ["Event Onset Date", "Date", "Week"], "age_group": ["Age Group"], "cases": ["Case Count", "Cases"],
    "hospitalized": ["Hospitalized Count", "Hospitalizations", "Hospital"],
}
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "yyyy/M/d", "M/d/yy"]


def parse_date(c: Column) -> Column:
    """The date by the first format that reads it, else null."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("date"), *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS[1:]])


def clinical_records(raw: DataFrame, metrics: tuple[str, ...] = (), losses: Observation | None = None) -> DataFrame:
    """Clinical long table with resolved names and typed columns; region names are trimmed.

    Each of ``metrics`` (cases, hospitalized) must have a column, else this raises; one that is not asked for and not there
    is null.  ``losses`` counts rows whose date or count cannot be read; such rows stay, with nulls.
    """
    optional = tuple({"age_group", "cases", "hospitalized"} - set(metrics))
    found = resolve_columns(raw, CLINICAL_COLUMNS, optional)
    typed = found.withColumn("region", F.trim("region"))
    faults = {}
    for c in ("cases", "hospitalized"):
        if c in found.columns:
            faults[f"unread_{c}"] = F.col(f"_{c}").isNotNull() & (F.trim(f"_{c}") != "") & F.col(c).isNull()
            typed = typed.withColumn(f"_{c}", F.col(c).cast("string")).withColumn(c, num(c))
        else:
            typed = typed.withColumn(c, F.lit(None).cast("double"))
    typed = typed.withColumn("event_date", parse_date(F.col("event_date")))
    return observed(typed, losses, undated=F.col("event_date").isNull(), **faults).drop("_cases", "_hospitalized")


def canonical_regions(records: DataFrame, counties: DataFrame, losses: Observation | None = None) -> DataFrame:
    """County records with the county's id as ``region``: ids padded, names looked up without case and kind of county.

    ``counties``: (county_fips, county_name).  Records of other levels stay; names that are not listed are dropped and counted.
    """
    def key(c: str) -> Column:
        return F.lower(strip_county_suffix(F.trim(c)))

    names = counties.filter(F.col("county_name").isNotNull()).groupBy(key("county_name").alias("_name")).agg(F.min("county_fips").alias("_id"))
    county = norm_region_level("region_level") == "county"
    number = F.col("region").rlike(r"^\s*\d{1,5}(\.0+)?\s*$")
    named = records.withColumn("_name", F.when(county & ~number, key("region"))).join(names, "_name", "left")
    region = F.when(~county, F.col("region")).when(number, canon_county("region")).otherwise(F.col("_id"))
    named = observed(named.withColumn("region", region), losses, unknown_region=F.col("region").isNull())
    return named.filter(F.col("region").isNotNull()).drop("_name", "_id")


def read_clinical(spark: SparkSession, path: str, metrics: tuple[str, ...] = (), losses: Observation | None = None) -> DataFrame:
    """CSV or Parquet, by extension, with the columns the file names; spreadsheets have to be exported first."""
    if path.lower().endswith((".xls", ".xlsx")):
        raise ValueError("export the spreadsheet to CSV first")
    if path.lower().rstrip("/").endswith(".parquet"):
        return clinical_records(spark.read.parquet(path), metrics, losses)
    return clinical_records(spark.read.option("header", True).csv(path), metrics, losses)


def county_lookup(df: DataFrame, fips: list[str] | None = None, name: list[str] | None = None) -> DataFrame:
    """(county_fips, county_name), one row per county, without the kind-of-county suffix."""
    f = resolve_column(df, fips or ["county_fips", "countyfips", "fips", "geoid"])
    n = resolve_column(df, name or ["county_name", "countyname", "namelsad", "name"])
    d = df.select(canon_county(f"`{f}`").alias("county_fips"), strip_county_suffix(F.col(f"`{n}`")).alias("county_name"))
    return d.filter(F.col("county_fips").isNotNull()).groupBy("county_fips").agg(F.min("county_name").alias("county_name"))


def read_population(df: DataFrame, key: str = "county_fips") -> DataFrame:
    """(key, population): id and count columns by name, ids padded, unreadable counts dropped."""
    f = resolve_column(df, ["county_fips", "fips", "geoid", "id"])
    p = resolve_column(df, ["total_population", "population", "pop"])
    d = df.select(canon_county(f"`{f}`").alias(key), num(F.col(f"`{p}`")).alias("population"))
    return d.filter(F.col(key).isNotNull() & F.col("population").isNotNull())


def site_population(df: DataFrame) -> DataFrame:
    """Population served summed over the polygons of a site."""
    return df.filter(F.col("wwtp").isNotNull()).groupBy(canon_site("wwtp").alias("wwtp")).agg(
        F.coalesce(F.sum("pop_served"), F.lit(0.0)).alias("pop_served"))


def commute_distance(commute: DataFrame, ruca: DataFrame) -> DataFrame:
    """Commute minutes to distance by settlement class of the ZIP.

    ``commute``: (geo_id, minutes), ``ruca``: (zip_code, ruca1).  A ZIP missing from ``ruca``
    is driven at the urban speed.
    """
    # Miles per hour by class, and km per mile.
    urban, suburban, rural, km = 30.0, 40.0, 55.0, 1.60934
    c = commute.select(F.regexp_extract(F.col("geo_id").cast("string"), r"(\d{5})\D*$", 1).alias("zip"), num("minutes").alias("minutes"))
    r = ruca.select(F.col("zip_code").cast("string").alias("zip"), num("ruca1").alias("ruca1"), F.lit(True).alias("_hit"))
    kind = F.when(F.col("_hit").isNull(), F.lit(None)).when(F.col("ruca1") == 1, "Urban").when(F.col("ruca1").isin(2.0, 4.0), "Suburban").otherwise("Rural")
    speed = F.when(F.col("kind") == "Suburban", suburban).when(F.col("kind") == "Rural", rural).otherwise(urban)
    miles = F.col("minutes") / 60 * F.col("mph")
    return c.join(r, "zip", "left").withColumn("kind", kind).withColumn("mph", speed).withColumn("miles", miles).select(
        "zip", "minutes", "kind", "mph", "miles", (F.col("miles") * km).alias("km"))
