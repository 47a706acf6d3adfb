"""Writers and export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netreach.operators.graph import site_edges
from netreach.plans.ordering import top_rows


def write_table(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet", rows_in_file: int = 5_000_000) -> DataFrame | None:
    """Write a table; with a partition column, return the manifest (value, path).

    Rows are clustered by the partition column; a value with more than ``rows_in_file`` rows is split further by a hash
    of the row, so it is written by several tasks and a retried task writes the same rows.
    """
    if partition is None:
        df.write.mode("overwrite").format(fmt).option("header", True).save(path)
        return None
    most = df.groupBy(partition).count().agg(F.max("count")).first()[0] or 0
    split = F.pmod(F.xxhash64(*df.columns), F.lit(most // rows_in_file + 1))
    df.repartition(F.col(partition), split).write.mode("overwrite").format(fmt).option("header", True).partitionBy(partition).save(path)
    return manifest(df, path, partition)


def manifest(df: DataFrame, path: str, partition: str) -> DataFrame:
    return df.select(partition).distinct().select(
        partition, F.concat(F.lit(f"{path.rstrip('/')}/{partition}="), F.col(partition).cast("string")).alias("path"))


def export_edges(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges of ``graph.site_edges`` with both names, centroid distance in km and component of the first end.

    Sites bring these with them where they meet; there can be very many edges, and none is shuffled.
    """
    n = nodes.join(comps.select("wwtp", "component"), "wwtp", "left")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = site_edges(n, ("name", "x", "y", "component"), tasks)
    d = F.sqrt(F.pow(F.col("u_x") - F.col("v_x"), F.lit(2)) + F.pow(F.col("u_y") - F.col("v_y"), F.lit(2)))
    return e.select("u", "v", "u_name", "v_name", d.alias("distance_km"), F.col("u_component").alias("component"))


def export_nodes(nodes: DataFrame, comps: DataFrame, degree: DataFrame) -> DataFrame:
    return nodes.join(comps, "wwtp", "left").join(degree.select("wwtp", "degree"), "wwtp", "left").select(
        "wwtp", "name", "x", "y", "component", "component_size", F.coalesce("degree", F.lit(0)).alias("degree"))


def export_site_table(sites: DataFrame, selection: DataFrame, official: DataFrame, tags: DataFrame, scores: DataFrame) -> DataFrame:
    """Every site with its category and sort position.

    Sorted by selected first, category, then rank; the position columns carry that order.
    """
    off = official.select("wwtp", F.lit(True).alias("official")).distinct()
    d = (
        sites.join(selection.select("wwtp", "selected", "avg_rank"), "wwtp", "left").join(off, "wwtp", "left")
        .join(tags.select("wwtp", "tag"), "wwtp", "left").join(scores.select("wwtp", "score"), "wwtp", "left")
        .fillna(False, ["selected", "official"]).fillna("none", ["tag"])
    )
    sel, offi, tag = F.col("selected"), F.col("official"), F.col("tag")
    cat = (
        F.when(sel & (offi | (tag != "none")), "transmission_reinforced").when(sel, "recommended")
        .when(offi, "existing").otherwise("other")
    )
    pos = F.when(cat == "transmission_reinforced", 0).when(cat == "recommended", 1).when(cat == "existing", 2).otherwise(3)
    return d.select("wwtp", "selected", "official", "tag", "score", "avg_rank", cat.alias("category"), pos.alias("category_order")).orderBy(
        F.desc("selected"), "category_order", F.asc_nulls_last("avg_rank"), "wwtp")


def export_top_scores(scores: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    d = scores.filter(F.col("score").isNotNull())
    if min_score is not None:
        d = d.filter(F.col("score") >= min_score)
    return top_rows(d, [F.desc("score"), F.col("wwtp")], k, "rank").select("rank", "wwtp", "score")


def export_county_rates(panel: DataFrame) -> DataFrame:
    return panel.select("disease", F.col("region").alias("county_fips"), "week", "rate")


def export_od_edges(edges: DataFrame, prefix: str) -> DataFrame:
    """Inbound and outbound totals per site for counties whose id starts with ``prefix``; gaps 0."""
    from netreach.operators.od import INBOUND, OUTBOUND

    e = edges.filter(F.col("county_fips").startswith(prefix))
    i = e.filter(F.col("direction") == INBOUND).groupBy("wwtp").agg(F.sum("volume").alias("inbound"))
    o = e.filter(F.col("direction") == OUTBOUND).groupBy("wwtp").agg(F.sum("volume").alias("outbound"))
    return i.join(o, "wwtp", "full").fillna(0.0, ["inbound", "outbound"])


def export_od_by_destination(edges: DataFrame) -> DataFrame:
    """Volume by destination: the site of inbound edges, the county of outbound ones."""
    from netreach.operators.od import INBOUND

    dest = F.when(F.col("direction") == INBOUND, F.col("wwtp")).otherwise(F.col("county_fips"))
    return edges.groupBy("direction", dest.alias("destination")).agg(F.sum("volume").alias("volume"))


def export_risk_table(summary: DataFrame, disease: str) -> DataFrame:
    d = disease.lower()
    return summary.select("wwtp", "week", F.col(f"import_risk_{d}").alias("import_risk"), F.col(f"export_risk_{d}").alias("export_risk"))


def attach_coordinates(df: DataFrame, sites: DataFrame, key: str = "wwtp") -> DataFrame:
    """Join plane coordinates and population; node ids such as ``W_<site>`` match as well."""
    s = sites.select(F.col("wwtp").alias("_k"), "x", "y", "pop_served")
    return df.withColumn("_k", F.regexp_replace(F.col(key), "^W_", "")).join(s, "_k", "left").drop("_k")


def top_with_coordinates(ranked: DataFrame, sites: DataFrame, k: int, score: str = "score") -> DataFrame:
    top = top_rows(ranked.filter(F.col(score).isNotNull()), [F.desc(score), F.col("wwtp")], k, "rank")
    return attach_coordinates(top.select("rank", "wwtp", score), sites)


def matrix_to_edges(wide: DataFrame, label: str = "node") -> DataFrame:
    """Labelled square matrix to (src, dst, value), zeros left out."""
    names = [c for c in wide.columns if c != label]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("dst"), F.col(f"`{c}`").cast("double").alias("value")) for c in names]))
    return wide.select(F.col(label).alias("src"), cells.alias("c")).select("src", "c.dst", "c.value").filter(F.col("value") != 0)


def edges_to_matrix(edges: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """Edge list to a labelled matrix for a given, small list of columns."""
    return edges.groupBy(F.col("src").alias("node")).pivot("dst", names).agg(F.sum(value)).fillna(0.0, names)


def sub_matrix(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.filter(F.col("src").startswith(prefix) & F.col("dst").startswith(prefix))
