"""SQL text of the domain tables; a query gets only the ones it names."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}

TABLES["fx_trips"] = """
SELECT CAST(l_shipdate AS DATE) AS day,
       CASE WHEN l_linestatus = 'F' THEN 'Destination' ELSE 'Origin' END AS direction,
       CAST(l_suppkey AS VARCHAR) AS site,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS bg,
       l_quantity AS volume, CAST(1 + c_custkey % 97 AS DOUBLE) AS area,
       greatest(c_acctbal, 0.0) AS population
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

TABLES["fx_daily"] = """
SELECT day, direction, site, county, SUM(volume) AS volume, SUM(area) AS area, SUM(population) AS population
FROM fx_trips GROUP BY day, direction, site, county"""

TABLES["fx_edges"] = """
SELECT CAST(date_trunc('week', day) AS DATE) AS week,
       CASE WHEN direction = 'Destination' THEN 'county_to_wwtp' ELSE 'wwtp_to_county' END AS direction,
       site AS wwtp, county AS county_fips, AVG(volume) AS volume, AVG(area) AS area, AVG(population) AS population
FROM fx_daily GROUP BY 1, 2, 3, 4"""

TABLES["fx_totals"] = """
SELECT *, total_in + total_out AS total_flow, total_out - total_in AS net_flow FROM (
SELECT week, wwtp, SUM(CASE WHEN direction = 'county_to_wwtp' THEN volume ELSE 0 END) AS total_in,
       SUM(CASE WHEN direction = 'wwtp_to_county' THEN volume ELSE 0 END) AS total_out
FROM fx_edges GROUP BY week, wwtp)"""

TABLES["fx_links"] = """
SELECT CAST(date_trunc('week', day) AS DATE) AS week, direction, bg AS bg_fips, site AS wwtp,
       SUM(volume) AS volume, MAX(area) AS area, MAX(population) AS population
FROM fx_trips GROUP BY 1, 2, 3, 4"""

TABLES["fx_clinical"] = """
SELECT 'county' AS region_level, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS region,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'COVID' WHEN '2' THEN 'Influenza' WHEN '3' THEN 'RSV' END AS disease,
       CAST(o_orderdate AS DATE) AS event_date, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
       c_mktsegment AS age_group, 1.0 AS cases, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS hospitalized
FROM orders JOIN customer ON o_custkey = c_custkey"""

TABLES["fx_site_clinical"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS region,
       CASE l_returnflag WHEN 'R' THEN 'COVID' WHEN 'A' THEN 'Influenza' ELSE 'RSV' END AS disease,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS week, 1.0 AS cases,
       CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS hospitalized
FROM lineitem"""

TABLES["fx_population"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips, COUNT(*) * 1000.0 AS population
FROM customer GROUP BY 1"""

TABLES["fx_sites"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS wwtp, greatest(s_acctbal, 0.0) AS pop_served,
       CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 1000 AS DOUBLE) AS y,
       CAST(20 + s_suppkey % 60 AS DOUBLE) AS radius,
       CASE WHEN s_suppkey % 5 = 0 THEN 'sentinel surveillance site' ELSE 'candidate' END AS act_sts,
       lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS county_fips, s_suppkey AS ord
FROM supplier"""

TABLES["fx_scores"] = """
SELECT CAST(l_suppkey AS VARCHAR) AS wwtp, ROUND(SUM(l_extendedprice), 2) AS score
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"""

TABLES["fx_series"] = """
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
       'C_' || lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS node, ROUND(SUM(l_extendedprice) / 1000, 2) AS x
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def _named(text: str) -> set[str]:
    return set(re.findall(r"\bfx_[a-z0-9_]+\b", text))


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the domain tables it uses, directly or through others."""
    need, frontier = set(), _named(sql)
    while frontier:
        need |= frontier
        frontier = set().union(*[_named(TABLES[n]) for n in frontier]) - need
    ctes = [f"{n} AS MATERIALIZED ({TABLES[n].strip()})" for n in TABLES if n in need]
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql
