"""Profiles of columns: type resolution and statistics of continuous, categorical and date features.

A feature is a column of text cells. Each cell is missing, a date, a number or a category. In ``reference`` mode a
column has the type of its last known cell, and only the cells after the last one of another type count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.scalars import CONTINUOUS, dt, jtrim, missing, num
from loomgrid.operators.selection import quartiles

DATE, NUMBER, CATEGORY = "date", "continuous", "categorical"
MOST_CATEGORIES = 200
_ID = r"^[0-9a-fA-F-]{36}\z"


def text_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns as text: timestamps to the second, doubles as the JVM writes them."""
    kinds = dict(df.dtypes)
    as_text = lambda c: F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd HH:mm:ss") if kinds[c].startswith("timestamp") else F.col(f"`{c}`").cast("string")
    return df.select(*[as_text(c).alias(c) for c in (columns or df.columns)])


def feature_name(name: str) -> str:
    """A column's name up to the first `` (``."""
    return name.split(" (", 1)[0].strip() if " (" in name else name


def kind_of(c: Column) -> Column:
    """date, continuous or categorical; null for a missing cell."""
    cell = jtrim(c)
    return F.when(missing(c), F.lit(None)).when(dt(cell).isNotNull(), DATE).when(cell.rlike(CONTINUOUS), NUMBER).otherwise(CATEGORY)


def typed_cells(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(feature, rid, kind, cell): one row for each cell; kind is null for a missing one."""
    cells = df.select(F.col(f"`{order}`").alias("rid"), F.explode(F.array(*[F.struct(F.lit(feature_name(c)).alias("feature"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns])).alias("x"))
    return cells.select("x.feature", "rid", kind_of(F.col("x.cell")).alias("kind"), jtrim(F.col("x.cell")).alias("cell"))


def missing_counts(cells: DataFrame) -> DataFrame:
    """(feature, missing, present)."""
    return cells.groupBy("feature").agg(F.count_if(F.col("kind").isNull()).alias("missing"), F.count("kind").alias("present"))


def resolve_types(cells: DataFrame) -> DataFrame:
    """(feature, kind, cut): the type of the last known cell, and the last row of another type (null if there's none).

    One aggregation: the last row of each type says both.
    """
    last = {k: F.max(F.when(F.col("kind") == k, F.col("rid"))) for k in (DATE, NUMBER, CATEGORY)}
    rows = cells.groupBy("feature").agg(*[v.alias(k) for k, v in last.items()])
    top = F.greatest(*last)
    kind = F.when(F.col(DATE) == top, DATE).when(F.col(NUMBER) == top, NUMBER).when(F.col(CATEGORY) == top, CATEGORY)
    cut = F.greatest(*[F.when(~F.coalesce(F.col(k) == top, F.lit(False)), F.col(k)) for k in last])
    return rows.select("feature", kind.alias("kind"), cut.alias("cut")).where("kind is not null")


def retained(cells: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The cells that count: of their feature's type and after its cut. ``types`` is a row for each column of the table."""
    types = F.broadcast((types if types is not None else resolve_types(cells)).withColumnRenamed("kind", "final"))
    return cells.join(types, "feature").where((F.col("kind") == F.col("final")) & (F.col("cut").isNull() | (F.col("rid") > F.col("cut")))).select("feature", "rid", "kind", "cell")


def totals(cells: DataFrame, kept: DataFrame, rows: DataFrame, mode: str = "cells") -> DataFrame:
    """One row, total: retained cells and missing ones of all columns (``cells``), or the number of rows (``rows``)."""
    if mode == "rows":
        return rows.agg(F.count(F.lit(1)).alias("total"))
    return kept.select(F.lit(1).alias("n")).unionAll(cells.where("kind is null").select(F.lit(1).alias("n"))).agg(F.count("n").alias("total"))


def continuous_stats(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(feature, count, min, max, mean, std_dev, q1, median, q3) of each column with known numbers: population deviation, floor-rank quartiles."""
    aggs = [f(c.cast("double")).alias(f"{n}{k}") for k, c in enumerate(columns.values()) for n, f in (("count", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_pop))]
    row = df.agg(*aggs)
    names = list(columns)
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"count{k}").alias("count"), F.col(f"min{k}").alias("min"), F.col(f"max{k}").alias("max"), F.col(f"mean{k}").alias("mean"), F.col(f"sd{k}").alias("std_dev")) for k, c in enumerate(names)])).alias("x")).select("x.*").where("count > 0")
    return long.join(F.broadcast(quartiles(df, columns)), F.col("feature") == F.col("name")).drop("name")


def fences(stats: DataFrame) -> DataFrame:
    """(feature, low, high): the bounds beyond which a value is an outlier."""
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return stats.select("feature", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def outliers(df: DataFrame, column: Column, keep: list[str]) -> DataFrame:
    """(value and the ``keep`` columns) of the rows strictly outside the fences."""
    bounds = fences(continuous_stats(df, {"x": column}))
    return df.select(*keep, column.cast("double").alias("value")).crossJoin(F.broadcast(bounds)).where("value < low or value > high").select(*keep, "value")  # one row of bounds


def histogram(df: DataFrame, column: Column) -> DataFrame:
    """(bin, lo, hi, label, n): up to 10 bins of width max(2 iqr / cbrt(n), range / 10), empty ones included; a constant column is one bin."""
    x = df.select(column.cast("double").alias("x")).where("x is not null")
    stats = F.broadcast(continuous_stats(x, {"x": F.col("x")}))
    span = F.col("max") - F.col("min")
    shape = stats.select(F.col("min").alias("lo"), F.col("max").alias("hi"), F.greatest(2 * (F.col("q3") - F.col("q1")) / F.cbrt("count"), span / 10).alias("width"))
    shape = shape.withColumn("bins", F.expr("if(hi = lo, 1, cast(ceil((hi - lo) / width) as int))"))
    counts = x.crossJoin(F.broadcast(shape)).select(F.expr("if(hi = lo, 0, cast(least(floor((x - lo) / width), bins - 1) as int))").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = shape.select("lo", "hi", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    ends = grid.select("bin", F.expr("if(hi = lo, lo, lo + bin * width)").alias("lo"), F.expr("if(hi = lo, hi, lo + (bin + 1) * width)").alias("hi"), (F.col("hi") == F.col("lo")).alias("flat"))
    short = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    label = F.when(F.col("flat"), F.format_string("[%.6f - %.6f]", "lo", "hi")).otherwise(F.concat(F.lit("["), short(F.col("lo")), F.lit(" - "), short(F.col("hi")), F.lit("]")))
    return ends.join(F.broadcast(counts), "bin", "left").select("bin", "lo", "hi", label.alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))  # at most ten rows


def category_counts(kept: DataFrame) -> DataFrame:
    """(feature, value, n) of categorical cells."""
    return kept.where(F.col("kind") == CATEGORY).groupBy("feature", F.col("cell").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def modes(counts: DataFrame, total: Column | int) -> DataFrame:
    """(feature, rank, value, n, percent): the two most frequent values, ties to the smaller value."""
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where("rank <= 2")  # a window group limit keeps two rows a task
    total = total if isinstance(total, Column) else F.lit(total)
    return top.select("feature", "rank", "value", "n", (F.col("n") / total * 100).alias("percent"))


def omitted(counts: DataFrame) -> DataFrame:
    """(feature, distinct_values, reason) of categorical features that aren't worth a profile."""
    sums = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.bool_or(F.col("value").rlike(_ID)).alias("ids"))
    share = F.col("d") / F.col("n") * 100
    reason = F.when((F.col("n") > 10) & (share >= 50), F.concat(F.lit("Too many unique values ("), share.cast("string"), F.lit("%)")))
    reason = reason.when(F.col("d") > MOST_CATEGORIES, F.lit(f"Exceeds maximum categories (more than {MOST_CATEGORIES})")).when(F.col("ids"), F.lit("Likely contains UUIDs"))
    return sums.select("feature", F.col("d").alias("distinct_values"), reason.alias("reason")).where("reason is not null")


def date_stats(df: DataFrame, day: Column) -> DataFrame:
    """(earliest, latest, mean, median, q1, q3, std_dev, count) of days: the mean is truncated towards zero, the deviation is in days."""
    x = df.select(F.unix_date(day.cast("date")).cast("double").alias("x")).where("x is not null")
    as_day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return continuous_stats(x, {"x": F.col("x")}).select(as_day("min").alias("earliest"), as_day("max").alias("latest"), as_day("mean").alias("mean"), as_day("median").alias("median"), as_day("q1").alias("q1"), as_day("q3").alias("q3"), "std_dev", "count")


def date_histogram(df: DataFrame, day: Column) -> DataFrame:
    """(day, n)."""
    return df.select(day.cast("date").alias("day")).where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def forced_codes(cells: DataFrame) -> DataFrame:
    """(cell, code): the numbers 1, 2, … of texts that aren't numbers, in the order of their first row.

    Codes number distinct texts only; a feature with so many that this matters is omitted from a profile anyway.
    """
    from loomgrid.operators.ranks import numbered

    first = cells.where(F.col("kind").isNotNull() & num(F.col("cell")).isNull()).groupBy("feature", "cell").agg(F.min("rid").alias("rid"))
    return numbered(first, ["rid"], "code", ["feature"]).select("feature", "cell", F.col("code").cast("double").alias("code"))


def profile(df: DataFrame, order: str, columns: list[str] | None = None, total: str = "cells", overrides: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The whole profile of a table: missing, types, continuous, categories, modes, dates, omitted, as lazy tables.

    ``overrides`` forces features to continuous or categorical. ``total`` is the base of all percentages.
    """
    from loomgrid.operators.ranks import scratch

    columns = columns or [c for c in df.columns if c != order]
    overrides = overrides or {}
    if bad := set(overrides.values()) - {NUMBER, CATEGORY}:
        raise ValueError(f"a feature can be forced to continuous or categorical, not {sorted(bad)}")
    cells = scratch(typed_cells(df, order, columns))
    forced = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])[F.col("feature")] if overrides else F.lit(None).cast("string")
    cells = cells.withColumn("kind", F.when(F.col("kind").isNotNull(), F.coalesce(forced, F.col("kind"))))
    kept = retained(cells)
    if NUMBER in overrides.values():
        codes = forced_codes(cells.where(F.col("feature").isin([k for k, v in overrides.items() if v == NUMBER])))
        numbers = kept.join(codes, ["feature", "cell"], "left").withColumn("x", F.when(F.col("kind") == NUMBER, F.coalesce(num(F.col("cell")), "code")))
    else:
        numbers = kept.withColumn("x", F.when(F.col("kind") == NUMBER, num(F.col("cell"))))
    numbers = scratch(numbers.withColumn("day", F.when(F.col("kind") == DATE, dt(F.col("cell")).cast("date"))))
    types = {r["feature"]: r["kind"] for r in resolve_types(cells).collect()}  # a row for each column
    of = lambda kind, x: {c: F.when(F.col("feature") == c, F.col(x)) for c, k in types.items() if k == kind}
    base = totals(cells, kept, df, total)
    counts = category_counts(numbers)
    out = {"missing": missing_counts(cells).crossJoin(F.broadcast(base)).withColumn("percent_missing", F.col("missing") / F.col("total") * 100), "types": resolve_types(cells), "categories": counts, "omitted": omitted(counts)}
    out["modes"] = modes(counts.crossJoin(F.broadcast(base)).select("feature", "value", "n", "total"), 1).drop("percent")
    if numbered_features := of(NUMBER, "x"):
        out["continuous"] = continuous_stats(numbers, numbered_features)
    if dates := [c for c, k in types.items() if k == DATE]:
        parts = [date_stats(numbers.where(F.col("feature") == c), F.col("day")).withColumn("feature", F.lit(c)) for c in dates]
        out["dates"] = parts[0]
        for p in parts[1:]:
            out["dates"] = out["dates"].unionByName(p)
    return out
