"""Clinical panels: complete entity x week tables, rates and their monthly forms."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netreach.functions.expr import clip_norm, ratio
from netreach.functions.keys import norm_disease, norm_metric, norm_region_level
from netreach.plans.staging import stage, stage_table


def full_panel(
    df: DataFrame,
    entities: DataFrame,
    values: list[str],
    entity: str = "region",
    keys: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Entities x every Monday in the observed (or given) range, gaps 0.

    ``keys`` adds further panel keys present in ``entities`` (for example the disease).  The
    week list is one array attached to every entity row and exploded there.
    """
    keys = keys or []
    lo = F.date_trunc("week", F.lit(start).cast("date")).cast("date") if start else F.min("week")
    hi = F.date_trunc("week", F.lit(end).cast("date")).cast("date") if end else F.max("week")
    bounds = df.agg(F.min(lo).alias("lo") if start else lo.alias("lo"), F.max(hi).alias("hi") if end else hi.alias("hi"))
    weeks = bounds.filter(F.col("lo").isNotNull()).select(
        F.sequence("lo", "hi", F.expr("interval 7 days")).alias("_weeks")
    )
    grid = (
        entities.select(*keys, entity).distinct().crossJoin(F.broadcast(weeks))  # one-row side
        .select(*keys, entity, F.explode("_weeks").alias("week"))
    )
    return grid.join(df, [*keys, entity, "week"], "left").fillna(0.0, values)


def drop_incomplete(panel: DataFrame, value: str = "rate", entity: str = "region") -> DataFrame:
    """Drop an entity that has any null value.

    An entity has one row per week, so one shuffle by entity does it.
    """
    broken = F.max(F.col(value).isNull()).over(Window.partitionBy(entity))
    return panel.withColumn("_broken", broken).filter(~F.col("_broken")).drop("_broken")


def clinical_long(
    records: DataFrame,
    level: str,
    metric: str,
    population: DataFrame | None = None,
    entities: DataFrame | None = None,
    disease: bool = True,
    kind: str = "rate",
) -> DataFrame:
    """Weekly sums per (disease, region) on the full panel, with rates per 100,000.

    ``population``: (region, population); below 1 the rate is null.  With ``disease`` the
    pathogen column splits the panel, so a mixed file is never summed across pathogens.
    """
    value = F.col("hospitalized") if metric == "hosp" else F.col("cases")
    keys = ["disease"] if disease else []
    rec = records.filter(norm_region_level("region_level") == level).select(
        *([norm_disease("pathogen").alias("disease")] if disease else []),
        "region",
        F.date_trunc("week", "event_date").cast("date").alias("week"),
        value.cast("double").alias("raw"),
    )
    if disease:
        rec = rec.filter(F.col("disease").isNotNull())
    weekly = rec.filter(F.col("region").isNotNull() & F.col("week").isNotNull()).groupBy(
        *keys, "region", "week"
    ).agg(F.coalesce(F.sum("raw"), F.lit(0.0)).alias("raw"))
    weekly = stage(weekly)  # the week range, the labels and the panel read it
    if entities is None:
        ents = weekly.select(*keys, "region").distinct()
    elif disease:
        names = weekly.agg(F.collect_set("disease").alias("_names"))  # one row, a handful of labels
        ents = entities.select("region").distinct().crossJoin(F.broadcast(names)).select(
            "region", F.explode("_names").alias("disease"))
    else:
        ents = entities.select("region")
    panel = full_panel(weekly, ents, ["raw"], keys=keys)
    if kind == "raw" or population is None:
        return panel.withColumn("rate", F.col("raw"))
    pop = population.select("region", "population")
    return panel.join(pop, "region", "left").withColumn(
        "rate", F.when(F.col("population") >= 1, F.col("raw") / F.col("population") * 1e5)
    )


def level_clinical(
    records: DataFrame, level: str, metric: str, population: DataFrame, entities: DataFrame
) -> DataFrame:
    """Complete rate panel of one level; entities come from the boundary layer."""
    panel = clinical_long(records, level, metric, population, entities)
    return drop_incomplete(panel).select("disease", "region", "week", "raw", "rate")


def county_clinical(records: DataFrame, metric: str, population: DataFrame, counties: DataFrame) -> DataFrame:
    return level_clinical(records, "county", metric, population, counties)


def site_clinical(records: DataFrame, metric: str, population: DataFrame, sites: DataFrame) -> DataFrame:
    return level_clinical(records, "sewershed", metric, population, sites)


class ObservedPanel(NamedTuple):
    """A complete rate panel of which only the observed cells are rows; the rate of any other of its cells is 0."""

    #: (region, week, population, cells): ``cells`` has (disease, raw) of each observed disease; complete regions alone.
    rows: DataFrame
    #: (region, population) of the regions without a null rate, one row each.
    regions: DataFrame
    #: One row (lo, hi, diseases): the first and last week and the sorted diseases.
    frame: DataFrame

    def rates(self) -> DataFrame:
        """(disease, region, week, raw, rate) of the observed cells."""
        d = self.rows.select("region", "week", "population", F.explode("cells").alias("c"))
        return d.select("c.disease", "region", "week", "c.raw", (F.col("c.raw") / F.col("population") * 1e5).alias("rate"))

    def zeros(self) -> DataFrame:
        """One row (n): the number of cells that are not observed."""
        weeks = F.floor(F.datediff("hi", "lo") / 7) + 1
        whole = self.regions.agg(F.count(F.lit(1)).alias("_r")).crossJoin(F.broadcast(self.frame))
        seen = self.rows.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("_k"))
        return whole.crossJoin(F.broadcast(seen)).select(
            (F.coalesce(F.col("_r") * F.size("diseases") * weeks, F.lit(0)) - F.col("_k")).cast("long").alias("n"))


def observed_site_clinical(records: DataFrame, metric: str, population: DataFrame, sites: DataFrame) -> ObservedPanel:
    """``site_clinical`` without a row for each site, week and disease.  ``population``: one row for each region."""
    value = F.col("hospitalized") if metric == "hosp" else F.col("cases")
    rec = records.filter(norm_region_level("region_level") == "sewershed").select(
        norm_disease("pathogen").alias("disease"), "region", F.date_trunc("week", "event_date").cast("date").alias("week"), value.cast("double").alias("raw"))
    rec = rec.dropna(subset=["disease", "region", "week"]).repartition("region", "week")  # one shuffle for both sums
    cells = rec.groupBy("region", "week", "disease").agg(F.coalesce(F.sum("raw"), F.lit(0.0)).alias("raw"))
    cells = stage_table(cells.groupBy("region", "week").agg(F.collect_list(F.struct("disease", "raw")).alias("cells")))
    # a rate is null for want of a population, in every week alike
    whole = stage_table(sites.select("region").distinct().join(population.select("region", "population"), "region").filter("population >= 1"))
    frame = cells.select("week", F.explode("cells.disease").alias("d")).agg(
        F.min("week").alias("lo"), F.max("week").alias("hi"), F.sort_array(F.collect_set("d")).alias("diseases"))
    frame = frame.crossJoin(F.broadcast(whole.agg(F.count(F.lit(1)).alias("_r"))))
    diseases = F.when(F.col("_r") > 0, F.col("diseases")).otherwise(F.array().cast("array<string>")).alias("diseases")
    return ObservedPanel(cells.join(whole, "region"), whole, stage(frame.select("lo", "hi", diseases)))


def counts_by_age(records: DataFrame, level: str) -> DataFrame:
    """Hospitalized counts per (week, region, age group); no age column means "All"."""
    age = F.col("age_group") if "age_group" in records.columns else F.lit("All")
    return (
        records.filter(norm_region_level("region_level") == level)
        .groupBy(F.date_trunc("week", "event_date").cast("date").alias("week"), "region", age.alias("age_group"))
        .agg(F.sum("hospitalized").alias("hospitalized"))
    )


def _month() -> Column:
    return F.date_format("week", "yyyy-MM").alias("year_month")


def rates_weekly_to_monthly(panel: DataFrame) -> DataFrame:
    """Rate -> implied count, summed per month, back to a rate."""
    implied = F.col("rate") * F.col("population") / 1e5
    g = panel.groupBy("disease", "region", _month()).agg(
        F.sum(implied).alias("count"), F.max("population").alias("population")
    )
    return g.withColumn("rate", ratio(F.col("count"), F.col("population")) * 1e5)


def rates_monthly_mean(panel: DataFrame) -> DataFrame:
    return panel.groupBy("disease", "region", _month()).agg(F.avg("rate").alias("rate"))


def verify_panel(panel: DataFrame, entity: str = "region", keys: list[str] | None = None) -> DataFrame:
    """One row: entities, weeks, rows and whether rows = entities x weeks."""
    ents = F.count_distinct(*(keys or []), entity)
    return panel.agg(
        ents.alias("entities"), F.count_distinct("week").alias("weeks"), F.count(F.lit(1)).alias("rows")
    ).withColumn("complete", F.col("rows") == F.col("entities") * F.col("weeks"))


def assert_panel(panel: DataFrame, entity: str = "region", keys: list[str] | None = None) -> None:
    row = verify_panel(panel, entity, keys).first()
    if not row["complete"]:
        raise ValueError(f"incomplete panel: {row.asDict()}")


def county_rate_wide(df: DataFrame) -> DataFrame:
    """Wide county file: mean rate by (week, county)."""
    return df.groupBy(F.date_trunc("week", "day").cast("date").alias("week"), "county").agg(
        F.avg("rate").alias("real")
    )


def flu_rsv_rates(df: DataFrame, pathogen: str, values: list[str]) -> DataFrame:
    """One pathogen; mean of every value by (week, county) plus the clipped norm of the first."""
    ids = ["county"] + (["county_fips"] if "county_fips" in df.columns else [])
    out = (
        df.filter(norm_disease("pathogen") == pathogen)
        .groupBy(F.date_trunc("week", "day").cast("date").alias("week"), *ids)
        .agg(*[F.avg(v).alias(v) for v in values])
    )
    return out.withColumns({"real": F.col(values[0]), "norm": clip_norm(F.col(values[0]))})


def viral_load(df: DataFrame, entity: str, value: str = "index") -> DataFrame:
    """Mean index by (week, entity) and its clipped norm."""
    return (
        df.groupBy(F.date_trunc("week", "day").cast("date").alias("week"), entity)
        .agg(F.avg(value).alias("real"))
        .withColumn("norm", clip_norm(F.col("real")))
    )


def site_clinical_alloc(df: DataFrame, coverage: list[str] | None = None) -> DataFrame:
    """Allocated site values as one row per (week, site, disease) with case and hosp columns.

    Missing values become 0; the hospital column falls back to cases where it was null.
    """
    d = df.withColumns({"disease": norm_disease("disease"), "metric": norm_metric("metric")})
    keys = [F.date_trunc("week", "week").cast("date").alias("week"), "wwtp", "disease"]
    aggs = [
        F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("case", "hosp")
    ] + [F.avg(c).alias(c) for c in coverage or []]
    out = d.groupBy(*keys).agg(*aggs)
    return out.withColumns(
        {"hosp": F.coalesce("hosp", "case", F.lit(0.0)), "case": F.coalesce("case", F.lit(0.0))}
    )


def syndromic(df: DataFrame, pathogen: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Week, county, norm and real from either file layout."""
    if "pathogen" in df.columns:
        out = flu_rsv_rates(df, pathogen, values or ["rate"])
    else:
        out = county_rate_wide(df).withColumn("norm", clip_norm(F.col("real")))
    return out.select("week", "county", "norm", "real").distinct()
