"""Null-aware scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column | str) -> Column:
    """Text or number to double; anything that is not a finite-looking number is null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def _present(cols: list[Column]) -> Column:
    return F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull())


def row_mean(cols: list[Column]) -> Column:
    """Mean of the non-null entries of a row."""
    a = _present(cols)
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total, F.size(a).cast("double"))


def row_min(cols: list[Column]) -> Column:
    return F.array_min(_present(cols))


def row_median(cols: list[Column]) -> Column:
    """Median of the non-null entries of a row."""
    a = F.array_sort(_present(cols))
    n = F.size(a)
    lo = F.try_element_at(a, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(a, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (lo + hi) / 2)


def row_count(cols: list[Column]) -> Column:
    return F.size(_present(cols))


def clip_norm(c: Column, top: float = 10.0) -> Column:
    """Clip to [0, top] and divide by top."""
    return clip(c, 0.0, top) / F.lit(float(top))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from moments; null when a side is constant."""
    cov = sxy - sx * sy / n
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    ok = (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
    return F.when(ok, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
