"""One column spec per query drives both sides of the comparison.

A spec reads ``"week:d wwtp:s n:i volume:f share:r flag:b"``: date, text, whole number, double
at 4 places, double at 6 places, boolean.  The letters w, q, h, p and k stand for 1, 7, 9, 10 and 11
places: short fractions would otherwise sit on a rounding tie, which engines break differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netreach.registry.sqltables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PLACES = {"w": 1, "f": 4, "r": 6, "q": 7, "h": 9, "p": 10, "k": 11}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _fields(spec):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), _PLACES[kind]) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _fields(spec):
        if kind == "d":
            c = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
        elif kind == "s":
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        else:
            c = f"ROUND(CAST({name} AS DOUBLE), {_PLACES[kind]}) + 0.0"
        out.append(f"{c} AS {name}")
    return with_tables(f"SELECT {', '.join(out)} FROM ({body}) AS result_rows")


def register(name: str, spec: str, sql: str | None = None):
    """Decorator for ``fn(spark, sf_dir)``; ``sql`` may use the ``fx_*`` tables."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: shape(fn(spark, sf), spec)
        if sql is not None:
            ORACLES[name] = shape_sql(sql, spec)
        return fn

    return wrap
