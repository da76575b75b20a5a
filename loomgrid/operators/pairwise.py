"""Statistics of pairs of columns: covariance, correlations, contingency tables and the chi-square test."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.ranks import numbered, scratch


def by_position(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row for each position in the compacted value lists of the features: missing values shift what is paired.

    ``cells`` is (feature, rid, x). Features are numbered once and pivoted by position, not joined pair by pair.
    """
    numbers = numbered(cells.select("feature", "rid", "x"), ["rid"], "pos", ["feature"])
    return numbers.groupBy("pos").agg(*[F.max(F.when(F.col("feature") == c, F.col("x"))).alias(c) for c in names])


def _both(a: str, b: str) -> tuple[Column, Column]:
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, x), F.when(known, y)


def _pairs(df: DataFrame, names: list[str], measure) -> DataFrame:  # noqa: ANN001
    """(feature1, feature2, value), mirrored, from one aggregation over all pairs; pairs without a value are left out."""
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, value double")
    row = df.agg(*[measure(*_both(a, b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(x).alias("feature1"), F.lit(y).alias("feature2"), F.col(f"p{k}").alias("value")) for k, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))])
    return row.select(F.explode(cells).alias("c")).select("c.*").where("value is not null and not isnan(value)")


def covariance(df: DataFrame, names: list[str]) -> DataFrame:
    """Sample covariance of rows in which both are known, two at least."""
    return _pairs(df, names, F.covar_samp)


def _correlation(x: Column, y: Column) -> Column:
    sx, sy = F.stddev_pop(F.when(y.isNotNull(), x)), F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when(F.count(x) > 1, F.try_divide(F.covar_pop(x, y), sx * sy))


def pearson(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson's correlation; constant columns and pairs with fewer than two rows are left out."""
    return _pairs(df, names, _correlation)


def average_ranks(df: DataFrame, column: Column, to: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value, by counts of values and running sums across range partitions."""
    counts = df.select(column.cast("double").alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    rows = scratch(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("below"))  # a row for each partition
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.join(F.broadcast(starts), "part").withColumn("up_to", inside + F.col("below"))
    return ranked.select("value", (F.col("up_to") - (F.col("n") - 1) / 2).alias(to))


def spearman(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson's correlation of average ranks, pair by pair over the rows in which both are known."""
    out = None
    for a, b in combinations(names, 2):
        x, y = _both(a, b)
        rows = scratch(df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null"))
        ranked = rows.join(average_ranks(rows, F.col("x"), "rx").withColumnRenamed("value", "x"), "x").join(average_ranks(rows, F.col("y"), "ry").withColumnRenamed("value", "y"), "y")
        own = pearson(ranked, ["rx", "ry"]).where("feature1 = 'rx'").select("value")
        both = own.select(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), "value").unionByName(own.select(F.lit(b).alias("feature1"), F.lit(a).alias("feature2"), "value"))
        out = both if out is None else out.unionByName(both)
    return out if out is not None else df.sparkSession.createDataFrame([], "feature1 string, feature2 string, value double")


def contingency(df: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """(feature1, feature2, value1, value2, n) of rows in which both are categories (not null), for every pair of columns, in one aggregation."""
    names = sorted(categories)
    pairs = F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), categories[a].alias("value1"), categories[b].alias("value2")) for a, b in combinations(names, 2)])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("value1 is not null and value2 is not null")
    return rows.groupBy("feature1", "feature2", "value1", "value2").agg(F.count(F.lit(1)).alias("n"))


def chi_square(counts: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(feature1, feature2, statistic, df, p_value) from contingency counts, for features of at most 200 categories each.

    ``categories`` (feature, value) adds values that never met a partner: their expected count is zero, and
    then, as with fewer than two categories or no rows, the p-value is NaN.
    """
    pair = ["feature1", "feature2"]
    a = counts.groupBy(*pair, "value1").agg(F.sum("n").alias("n1"))
    b = counts.groupBy(*pair, "value2").agg(F.sum("n").alias("n2"))
    if categories is not None:
        pairs = counts.select(*pair).distinct()
        a = pairs.join(categories.select(F.col("feature").alias("feature1"), F.col("value").alias("value1")), "feature1").join(a, [*pair, "value1"], "left").fillna(0, ["n1"]).select(*pair, "value1", "n1")
        b = pairs.join(categories.select(F.col("feature").alias("feature2"), F.col("value").alias("value2")), "feature2").join(b, [*pair, "value2"], "left").fillna(0, ["n2"]).select(*pair, "value2", "n2")
    total = counts.groupBy(*pair).agg(F.sum("n").alias("t"))
    grid = a.join(b, pair).join(total, pair).join(counts, [*pair, "value1", "value2"], "left")  # at most 200 x 200 cells for each pair of columns
    expected = F.col("n1") * F.col("n2") / F.col("t")
    term = F.try_divide(F.pow(F.coalesce("n", F.lit(0)) - expected, 2), expected)
    sums = grid.groupBy(*pair).agg(F.when(F.count_if(expected == 0) == 0, F.sum(term)).alias("statistic"), ((F.count_distinct("value1") - 1) * (F.count_distinct("value2") - 1)).alias("df"))

    @F.pandas_udf("double")
    def p(statistic, df):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([math.nan if s is None or s != s or k < 1 else chi_square_tail(s, int(k)) for s, k in zip(statistic, df)], dtype="float64")

    return sums.select(*pair, "statistic", "df", F.coalesce(p("statistic", "df"), F.lit(math.nan)).alias("p_value"))  # NaN comes back from pandas as null


def chi_square_tail(statistic: float, df: int) -> float:
    """The probability of a larger statistic: the upper regularised gamma function, by a series or a continued fraction."""
    a, x = df / 2, statistic / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h
