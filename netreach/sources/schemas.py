"""Explicit schemas of the text inputs; nothing is inferred from data."""

from pyspark.sql import types as T


def _schema(**cols: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "t": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in cols.items()])


# Measures of text files are read as text and cast with `num`, so one bad cell is one null.
DAILY_OD = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("direction", "Sewershed-O", "Sewershed-D", "County", "Volume", "Area", "Population")]
)
CLINICAL = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("Region Level", "Region Name", "Pathogen Name", "Event Onset Date", "Age Group", "Case Count", "Hospitalized Count")]
)
WEEKLY_EDGES = _schema(week="t", direction="s", wwtp="s", county_fips="s", volume="d", area="d", population="d")
BG_LINK = _schema(week="t", direction="s", bg_fips="s", wwtp="s", volume="d", area="d", population="d")
