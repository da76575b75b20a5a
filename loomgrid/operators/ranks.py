"""Exact ranks and running values over whole tables without a window that gathers all rows in one task.

Rows are range-partitioned by their order, which the sort uses anyway; each partition is numbered on its own,
and one small row for each partition carries the counts of the partitions before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Where scratch tables go when the session names no spark.checkpoint.dir (tests on one machine).
LOCAL_SCRATCH = "/tmp/checkpoints/loomgrid"
_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names in spark.checkpoint.dir; a local one only where it names none and runs on one machine."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or LOCAL_SCRATCH)
    return context.getCheckpointDir().get()


def scratch(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` as a table in the shared scratch folder: its lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, label: str = "files") -> str:
    """A folder of its own in the scratch folder, which :func:`release` deletes with the tables."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, as a scratch table; the scratch tables that it took on the way are deleted."""
    before = len(_MADE)
    out = scratch(make(), label)
    own = _MADE.pop()
    release(out.sparkSession, before)
    _MADE.append(own)
    return out


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes the scratch tables made so far (but the first ``since``), once the results that read them have been written; says how many."""
    conf, place = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    done = 0
    while len(_MADE) > since:
        path = place(_MADE.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def _partitioned(df: DataFrame, order: list) -> DataFrame:  # noqa: ANN001
    """Sorted rows with their partition and their place in it, written once so that both stay what they are."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id holds the partition in its upper bits and the place in the lower 33
    own = placed.withColumn("__id", F.monotonically_increasing_id())
    return scratch(own.withColumn("__part", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))


def numbered(df: DataFrame, order: list, to: str = "pos", by: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """``df`` with the number of each row, from 1, within its ``by`` group (or the whole table) in the given order."""
    by = by or []
    rows = _partitioned(df, [*by, *order])
    counts = rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__part").alias("__p"), "__first", before.alias("__before"))
    on = (F.col("__part") == F.col("__p"))
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    joined = rows.join(starts, on)
    return joined.withColumn(to, F.col("__before") + F.col("__place") - F.col("__first") + 1).select(*df.columns, to)


def _carried(rows: DataFrame, names: list[str], forward: bool) -> DataFrame:
    """For each partition the last (first) known values of the partitions before (after) it: one row for each."""
    pick = F.max_by if forward else F.min_by
    edge = rows.groupBy("__part").agg(*[pick(F.col(f"__v_{k}"), F.when(F.col(f"__v_{k}").isNotNull(), F.col("__place"))).alias(k) for k in names])
    # running from the far end, since a frame that reaches forward is scanned anew for each row
    before = Window.partitionBy(F.lit(0)).orderBy("__part" if forward else F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    return edge.select("__part", *[F.last(k, ignorenulls=True).over(before).alias(f"__{'b' if forward else 'a'}_{k}") for k in names])


def neighbours(df: DataFrame, order: list, values: dict[str, Column], forward: bool = True, backward: bool = True, row: str | None = None) -> DataFrame:  # noqa: ANN001
    """``df`` with ``prev_<name>`` and ``next_<name>``: the nearest known value at or before and at or after each row.

    Within a partition by a window, across partitions by one carried row for each partition. With ``row``, rows are
    numbered from 1 in a column of that name, which the values may use.
    """
    rows = _partitioned(df, order)
    if row:
        before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        rows = rows.join(F.broadcast(starts), "__part").withColumn(row, F.col("__before") + F.col("__place") + 1).drop("__before")  # a row for each partition
    rows = rows.withColumns({f"__v_{k}": v for k, v in values.items()})
    out, inside = rows, Window.partitionBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    if forward:
        out = out.join(F.broadcast(_carried(rows, list(values), True)), "__part")  # a row for each partition
    if backward:
        out = out.join(F.broadcast(_carried(rows, list(values), False)), "__part")
    made = []
    for wanted, side, held, frame in ((forward, "prev", "b", inside.orderBy("__place")), (backward, "next", "a", inside.orderBy(F.desc("__place")))):
        made += [F.coalesce(F.last(f"__v_{k}", ignorenulls=True).over(frame), F.col(f"__{held}_{k}")).alias(f"{side}_{k}") for k in values if wanted]
    return out.select(*df.columns, *([row] if row else []), *made)
