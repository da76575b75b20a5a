"""Filling missing cells, and scaling columns by their own statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import blank, java_double, num
from loomgrid.operators.ranks import neighbours
from loomgrid.operators.selection import medians

STRATEGIES = ("constant", "mean", "median", "mode", "forward", "backward", "interpolate")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _known(name: str) -> Column:
    cell = _c(name).cast("string")
    return F.when(~blank(cell), cell)


def fill_missing(df: DataFrame, strategy: str, columns: list[str] | None = None, constant: str = "", order: str | None = None) -> DataFrame:
    """Blank cells filled: by a constant, the column's mean, median or mode, the value before or after, or a line between neighbours.

    Mean and median leave a column alone that holds a cell that is neither blank nor a number. Of equally frequent
    modes the smallest counts. The last three need the ``order`` column. An unknown strategy changes nothing.
    """
    strategy = (strategy or "").lower()
    columns = [c for c in (columns or df.columns) if c in df.columns and c != order]
    if strategy not in STRATEGIES or not columns:
        return df
    if strategy == "constant":
        return df.withColumns({c: F.when(blank(_c(c).cast("string")), F.lit(constant)).otherwise(_c(c)) for c in columns})
    if strategy in ("mean", "median"):
        middle = medians(df, {c: num(_known(c)) for c in columns}) if strategy == "median" else {}
        value = lambda c: F.avg(num(_known(c))) if strategy == "mean" else F.max(F.lit(middle.get(c)).cast("double"))
        made = [F.when(F.count_if(_known(c).isNotNull() & num(_known(c)).isNull()) == 0, java_double(value(c))).alias(f"__fill{k}") for k, c in enumerate(columns)]
        return _filled(df, df.agg(*made), columns)
    if strategy == "mode":
        return _filled(df, _modes(df, columns), columns)
    if order is None:
        raise ValueError(f"{strategy} needs an order column")
    if strategy == "interpolate":
        return interpolate(df, columns, order)
    forward = strategy == "forward"
    side = "prev" if forward else "next"
    values = {f"v{k}": _known(c) for k, c in enumerate(columns)}
    near = neighbours(df, [order], values, forward, not forward)
    return near.withColumns({c: F.coalesce(_known(c), F.col(f"{side}_v{k}"), _c(c)) for k, c in enumerate(columns)}).select(*df.columns)


def _filled(df: DataFrame, row: DataFrame, columns: list[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(row))  # one row
    return joined.select(*[F.when(blank(_c(c).cast("string")), F.coalesce(F.col(f"__fill{columns.index(c)}"), _c(c))).otherwise(_c(c)).alias(c) if c in columns else _c(c) for c in df.columns])


def _modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value of each column, by counts of distinct values and then one row."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _known(c).alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.k", "x.v").where("v is not null")
    counts = cells.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("k").agg(F.max("n").alias("most"))
    tied = counts.join(F.broadcast(best), "k").where("n = most").groupBy("k").agg(F.min("v").alias("v"))
    return tied.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"__fill{k}") for k in range(len(columns))])


def interpolate(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Blank cells on the line, by row number, between the nearest numbers on both sides; unchanged without one of them."""
    values = {f"v{k}": F.when(num(_known(c)).isNotNull(), F.struct(F.col("__row").alias("r"), num(_known(c)).alias("x"))) for k, c in enumerate(columns)}
    near = neighbours(df, [order], values, row="__row")
    made = {}
    for k, c in enumerate(columns):
        a, b = F.col(f"prev_v{k}"), F.col(f"next_v{k}")
        at = a["x"] + (b["x"] - a["x"]) * (F.col("__row") - a["r"]) / (b["r"] - a["r"])
        made[c] = F.when(_known(c).isNull() & a.isNotNull() & b.isNotNull(), java_double(at)).otherwise(_c(c))
    return near.withColumns(made).select(*df.columns)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers scaled to [0, 1]; other cells, and columns with one value only, stay."""
    made = [f(num(_c(c))).alias(f"__{n}{k}") for k, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    scaled = lambda k, c: F.try_divide(num(_c(c)) - F.col(f"__lo{k}"), F.col(f"__hi{k}") - F.col(f"__lo{k}"))
    return _scaled(df, made, columns, scaled)


def z_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as distances from the mean in population standard deviations; other cells and constant columns stay."""
    made = [f(num(_c(c))).alias(f"__{n}{k}") for k, c in enumerate(columns) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return _scaled(df, made, columns, lambda k, c: F.try_divide(num(_c(c)) - F.col(f"__mean{k}"), F.col(f"__sd{k}")))


def _scaled(df: DataFrame, made: list[Column], columns: list[str], scaled) -> DataFrame:  # noqa: ANN001
    if not columns:
        return df
    joined = df.crossJoin(F.broadcast(df.agg(*made)))  # one row
    return joined.select(*[F.coalesce(java_double(scaled(columns.index(c), c)), _c(c).cast("string")).alias(c) if c in columns else _c(c) for c in df.columns])
