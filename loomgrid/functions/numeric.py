"""Scalar functions on number and date cells: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions.scalars import dt, java_double, num


def java_pattern(pattern: str | None) -> str:
    """A date pattern in which Y and D mean year and day of the month."""
    return (pattern or "yyyy-MM-dd").replace("Y", "y").replace("D", "d")


def standard_date(c: Column, pattern: str | None = None) -> Column:
    """A cell that is a date, written in ``pattern``; others as they are."""
    return F.coalesce(F.date_format(dt(c), java_pattern(pattern)), c)


def date_parts(c: Column) -> dict[str, Column]:
    when = dt(c)
    return {"year": F.year(when).cast("string"), "month": F.month(when).cast("string"), "day": F.dayofmonth(when).cast("string")}


def rounded(x: Column, places: int) -> Column:
    """Half up at ``places`` decimals, towards positive infinity, as a double."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + 0.5).cast("double") / scale


def standard_number(c: Column, mode: str = "double") -> Column:
    """double, int_round (half up) or int_trunc of a cell that is a number; others as they are."""
    x = num(c)
    if mode == "int_round":
        shaped = F.floor(x + 0.5).cast("string")
    elif mode == "int_trunc":
        shaped = x.try_cast("bigint").cast("string")
    else:
        shaped = java_double(x)
    return F.coalesce(shaped, c)


def round_decimals(c: Column, places: int) -> Column:
    return F.coalesce(java_double(rounded(num(c), places)), c)


def convert(c: Column, kind: str) -> Column:
    """integer (truncated), float, boolean (true in any case, else false) or string; what can't be converted stays."""
    kind = (kind or "").lower()
    if kind in ("integer", "int"):
        return F.coalesce(num(c).try_cast("bigint").cast("string"), c)
    if kind in ("float", "double"):
        return F.coalesce(java_double(num(c)), c)
    if kind in ("boolean", "bool"):
        return F.when(c.isNotNull(), (F.lower(c) == "true").cast("string"))
    return c


def bin_of(c: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """The label of the bin [edge, next edge) of a number, of the last edge for what is not below it, or unknown; null for other cells."""
    x, labels = num(c), labels or []
    name = lambda k, other: labels[k] if k < len(labels) else other
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for k in range(len(edges) - 1):
        out = out.when((x >= edges[k]) & (x < edges[k + 1]), F.lit(name(k, f"bin_{k}")))
    if edges:
        out = out.when(x >= edges[-1], F.lit(name(len(edges) - 1, f"bin_{len(edges) - 1}")))
    return out.otherwise(F.lit("unknown"))
