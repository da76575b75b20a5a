"""Exact order statistics in two scans, without sorting or shuffling the values.

A mergeable sketch brackets each wanted rank; the second scan counts what lies below a bracket and what lies in
it, so only the few values within brackets are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def at_ranks(df: DataFrame, columns: dict[str, Column], fractions: tuple[float, ...]) -> DataFrame:
    """(name, fraction, n, value): of the n known values of each column, sorted, that at min(floor(fraction * n), n - 1).

    NaN counts as known and largest. A column without known values gives no rows.
    """
    eps, names = 2 / ACCURACY, list(columns)
    bounds = [min(1.0, max(0.0, p + s * eps)) for p in fractions for s in (-1, 1)]
    values = df.select(*[columns[c].cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    first = values.agg(*[f for k in range(len(names)) for f in (F.percentile_approx(f"c{k}", [float(b) for b in bounds], ACCURACY).alias(f"b{k}"), F.count(f"c{k}").alias(f"n{k}"))]).first()
    brackets = [(k, j, first[f"n{k}"], min(int(p * first[f"n{k}"]), first[f"n{k}"] - 1), first[f"b{k}"][2 * j], first[f"b{k}"][2 * j + 1]) for k in range(len(names)) if first[f"n{k}"] for j, p in enumerate(fractions)]
    if not brackets:
        return df.sparkSession.createDataFrame([], "name string, fraction double, n bigint, value double")
    # every value goes to the brackets that hold it, and as a mark below those that are above it
    marks = F.array(*[F.when(F.col(f"c{k}") < F.lit(lo), F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("x"))).when(F.col(f"c{k}") <= F.lit(hi), F.struct(F.lit(i).alias("i"), F.col(f"c{k}").alias("x"))) for i, (k, _, _, _, lo, hi) in enumerate(brackets)])
    counts = values.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).groupBy("m.i", "m.x").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("i").orderBy(F.col("x").asc_nulls_first())
    up_to = counts.withColumn("up_to", F.sum("n").over(order))
    wanted = F.create_map(*[x for i, b in enumerate(brackets) for x in (F.lit(i), F.lit(b[3] + 1))])
    chosen = up_to.where((F.col("up_to") >= wanted[F.col("i")]) & F.col("x").isNotNull()).groupBy("i").agg(F.min("x").alias("value"))
    named = lambda pick, kind: F.create_map(*[x for i, b in enumerate(brackets) for x in (F.lit(i), F.lit(pick(b)).cast(kind))])[F.col("i")]
    return chosen.select(named(lambda b: names[b[0]], "string").alias("name"), named(lambda b: fractions[b[1]], "double").alias("fraction"), named(lambda b: b[2], "bigint").alias("n"), "value")


def quartiles(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, q1, median, q3) of each column that has known values."""
    found = at_ranks(df, columns, (0.25, 0.5, 0.75))
    pick = lambda p: F.max(F.when(F.col("fraction") == p, F.col("value")))
    return found.groupBy("name").agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """The exact median of each column that has known values, the mean of the middle two for an even number."""
    counts = df.agg(*[F.count(c).alias(f"n{k}") for k, c in enumerate(columns.values())]).first()
    out = {}
    for k, (name, column) in enumerate(columns.items()):
        if n := counts[k]:
            middle = sorted({(n - 1) // 2, n // 2})
            rows = at_ranks(df, {name: column}, tuple((r + 0.5) / n for r in middle)).collect()
            out[name] = sum(r["value"] for r in rows) / len(rows)
    return out
