"""Row operators: which rows stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.scalars import all_of, any_of, blank, num


def _c(name: str):  # noqa: ANN202
    return F.col(f"`{name}`")


def remove_empty_rows(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows with at least one cell that isn't blank."""
    return df.where(any_of([~blank(_c(c).cast("string")) for c in df.columns if c not in ignore]))


def remove_duplicates(df: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct rows; with an ``order`` column, which isn't compared, the first of equal rows.

    The first is found by one hash aggregation with partial sums, not by a sorted window, so many copies of one
    row meet as one row for each task.
    """
    if order is None:
        return df.dropDuplicates()
    cells = [c for c in df.columns if c != order]
    return df.groupBy(*[_c(c) for c in cells]).agg(F.min(_c(order)).alias(order)).select(*df.columns)


def remove_rows_with_pattern(df: DataFrame, column: str | None, pattern: str | None) -> DataFrame:
    """Drops rows in whose cell ``pattern`` is found; null cells and unknown columns keep the row."""
    if not column or pattern is None or column not in df.columns:
        return df
    return df.where(~F.coalesce(_c(column).rlike(pattern), F.lit(False)))


def keep_only_numeric_rows(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Rows in which each listed column holds a number, or a text that starts with one."""
    if not columns:
        return df
    return df.where(all_of([F.coalesce(num(_c(c)), F.lit(None)).isNotNull() if c in df.columns else F.lit(False) for c in columns]))


def dedupe_key(columns: list[str]):  # noqa: ANN201
    """All cells of a row as ``name=value`` in the order of the names, joined by bars."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(_c(c).cast("string"), F.lit(""))) for c in sorted(columns)])


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:  # noqa: ANN001
    """The first row of each key by ``order``."""
    own = "__first"
    return df.withColumn(own, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(own) == 1).drop(own)
