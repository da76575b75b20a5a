"""Column operators: splitting, merging, bins, conversions and the columns derived from texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import numeric, text
from loomgrid.functions.scalars import jtrim


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def split_column(df: DataFrame, column: str, delimiter: str | None = ",", names: list[str] | None = None) -> DataFrame:
    """The parts of a column as new columns, trimmed, empty ones kept; without ``names`` as many as the longest cell has."""
    if column not in df.columns:
        return df
    parts = F.split(_c(column), re.escape(delimiter or ","), -1)
    if not names:
        most = df.agg(F.max(F.size(parts))).first()[0] or 0
        names = [f"{column}_part{k + 1}" for k in range(max(most, 0))]
    return df.withColumns({name: jtrim(F.get(parts, F.lit(k))) for k, name in enumerate(names)})


def merge_columns(df: DataFrame, columns: list[str], delimiter: str = " ", to: str = "merged_column") -> DataFrame:
    """The cells of several columns that aren't empty, joined."""
    return df.withColumn(to, F.concat_ws(delimiter, *[F.when(_c(c) != "", _c(c)) for c in columns if c in df.columns]))


def convert_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: numeric.convert(_c(c), k) for c, k in kinds.items() if c in df.columns})


def bin_column(df: DataFrame, column: str, edges: list[float], labels: list[str] | None = None) -> DataFrame:
    return df.withColumn(f"{column}_binned", numeric.bin_of(_c(column), edges, labels)) if edges and column in df.columns else df


def with_date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_year``, ``_month`` and ``_day`` of each column, null where a cell is no date."""
    return df.withColumns({f"{c}_{k}": v for c in columns for k, v in numeric.date_parts(_c(c)).items()})


def with_email_domains(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_domain": text.email_domain(_c(c)) for c in columns})


def with_url_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_{k}": v for c in columns for k, v in text.url_parts(_c(c)).items()})


def each(df: DataFrame, columns: list[str], function) -> DataFrame:  # noqa: ANN001
    """``function`` applied to the listed columns in one projection."""
    wanted = set(columns)
    return df.select(*[function(_c(c)).alias(c) if c in wanted else F.col(f"`{c}`") for c in df.columns])
