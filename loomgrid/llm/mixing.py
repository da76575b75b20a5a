"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of ``total`` rows and weight ``w`` is repeated ``w * rows / n`` times in the mean. Each row
inverts the Poisson distribution with that mean at a number in [0, 1) taken from a hash of (seed, id), is
repeated that often, and all copies are dealt out by a hash and sorted by it within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import OWN, materialize, rest_of, small_or_not

SEED = 17
ALPHA = 0.5


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, rows: int | None = None) -> DataFrame:
    """(source, n, weight, rate) of each source; rate is the mean number of copies of its rows.

    ``weights`` names the weight of each source; others get none. Without it a source of n rows weighs
    n ** alpha. The weights are divided by their sum. ``rows`` is the expected size of the mix, by default
    the size of ``docs``. Null is a source of its own, which ``weights`` names None.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "sources")
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("all_weights"), F.sum("n").alias("all_rows"))
    total = F.col("all_rows") if rows is None else F.lit(rows)
    rated = weighed.crossJoin(F.broadcast(sums)).where("all_weights > 0 and weight > 0")  # sums is one row
    return rated.select("source", "n", (F.col("weight") / F.col("all_weights")).alias("weight"), (F.col("weight") / F.col("all_weights") * total / F.col("n")).alias("rate"))


def copies_at(rate: str, uniform: str) -> Column:
    """How often a row is repeated: the Poisson distribution with mean ``rate`` inverted at ``uniform``, both columns.

    log p(j) = -rate + j log(rate) - log(j!) is summed in logarithms, so that no rate is too large for a double. A row
    takes steps in proportion to its rate, as it gives copies, and holds two sums and no table.
    """
    step = "s.at + if(j = 0, 0D, ln(s.rate) - ln(j))"
    more = f"s.sum + exp({step} - s.rate)"
    return F.expr(
        f"aggregate(sequence(0, cast(ceil({rate} + 12 * sqrt({rate}) + 30) as int)), named_struct('rate', {rate}, 'u', {uniform}, 'at', 0D, 'sum', 0D, 'n', 0),"
        f" (s, j) -> named_struct('rate', s.rate, 'u', s.u, 'at', {step}, 'sum', {more}, 'n', s.n + if({more} <= s.u, 1, 0)), s -> s.n)"
    )


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, rows: int | None = None, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated as its source's rate says, in shuffled order, and its number ``copy`` from 1.

    Rows of one id get the same number of copies; a null id counts as the text's digest, and null of both as
    one id. A column named copy is replaced. An empty table stays empty.
    """
    own = [f"{OWN}{x}" for x in ("key", "rate", "n", "source", "at")]
    key, rate, n, source, at = own
    rates = source_rates(docs, source_col, weights, alpha, rows).select(F.col("source").alias(source), F.col("rate").alias(rate))
    name = F.col(f"`{id_col}`").cast("string")
    name = F.coalesce(name, F.concat(F.lit("t"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))) if text_col in docs.columns else F.coalesce(name, F.lit("t"))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    drawn = docs.withColumn(key, name).join(small_or_not(rates), F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    drawn = drawn.withColumn(at, uniform).withColumn(n, copies_at(rate, at)).where(F.col(n) > 0)
    kept = rest_of(docs, "copy")
    copies = drawn.select(*kept, F.col(key), F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy"))
    dealt = copies.withColumn(key, F.xxhash64(F.lit(seed), key, "copy", F.monotonically_increasing_id()))
    return dealt.repartition(F.col(key)).sortWithinPartitions(key).drop(key)
