"""Canonical join keys and label normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canon_site(c: Column | str, squeeze: bool = False) -> Column:
    """Trimmed lower-case site name; ``squeeze`` also folds inner white space."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.regexp_replace(s, r"\s+", " ") if squeeze else s


def zero_pad(c: Column, width: int) -> Column:
    """Left-pad with zeros, never cutting longer values."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def canon_county(c: Column | str) -> Column:
    """Five-digit county id from numbers or text such as ``8001.0``; blank is null."""
    s = F.regexp_replace(F.trim(_c(c).cast("string")), r"\.0+$", "")
    return F.when(F.length(s) > 0, zero_pad(s, 5))


def area_county(c: Column | str) -> Column:
    """County part of a fine-area id."""
    return F.substring(zero_pad(F.trim(_c(c).cast("string")), 12), 1, 5)


def canon_area(c: Column | str) -> Column:
    return zero_pad(F.regexp_replace(F.trim(_c(c).cast("string")), r"\.0+$", ""), 12)


def drop_historic(df: DataFrame, *cols: str) -> DataFrame:
    """Remove rows where any of the columns mentions "historic"."""
    for col in cols:
        df = df.filter(~F.coalesce(F.lower(F.col(col)), F.lit("")).contains("historic"))
    return df


#: The spellings that input files use; "covid-19" is an addition.
DISEASE_NAMES = {
    "COVID": ["covid", "sars-cov-2", "sars cov 2", "sars_cov_2", "sarscov2", "covid-19"],
    "Influenza": ["influenza", "flu"],
    "RSV": ["rsv"],
}


def norm_disease(c: Column | str) -> Column:
    """COVID / Influenza / RSV from their listed names alone; of other labels, trimmed, every run of letters is capitalised."""
    s = F.lower(F.trim(_c(c)))
    runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    found = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")
    for name, listed in DISEASE_NAMES.items():
        found = F.when(s.isin(*listed), name).otherwise(found)
    return found


def norm_region_level(c: Column | str) -> Column:
    s = F.lower(F.trim(_c(c)))
    return (
        F.when(s.contains("county"), "county")
        .when(s.contains("sewer") | s.contains("wwtp") | s.contains("plant") | s.contains("utility"), "sewershed")
        .otherwise(s)
    )


def norm_metric(c: Column | str) -> Column:
    """Hospital wording wins over case wording."""
    s = F.lower(F.trim(_c(c)))
    return F.when(s.contains("hosp"), "hosp").when(s.contains("case"), "case").otherwise(s)


def strip_county_suffix(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"(?i)\s+(county|parish|borough|municipality)\s*$", ""))
