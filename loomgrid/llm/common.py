"""What the operators of this subpackage share: scratch tables, bounded broadcasts, row names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.ranks import scratch

#: Internal columns start with this, so that columns of the input can have any other name.
OWN = "__lg_"
#: Rows of a side that may be broadcast after they were counted.
BROADCAST_ROWS = 200_000
#: Rows of one key that a shuffled join takes without a look at the share.
HOT_ROWS = 256
#: Bytes of a batch of rows that goes to a Python worker, or the one row that is larger.
BATCH_BYTES = 4 << 20
#: What this Python worker keeps from task to task, by operator: of one at a time.
_KEPT: dict[str, dict] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder; ``loomgrid.operators.ranks.release`` deletes such tables."""
    return scratch(df, label)


def rest_of(docs: DataFrame, *taken: str) -> list[Column]:
    """The columns of ``docs`` whose names none of ``taken`` uses, whatever their case."""
    names = {name.lower() for name in taken}
    return [docs[f"`{c}`"] for c in docs.columns if c.lower() not in names]


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_counted(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row for each key and in ``n`` how many of ``rows`` have it.

    A key with more than one in ``most`` of all rows would gather them in one task. There are fewer than ``most``
    such keys, so their rows of ``table`` are broadcast; the others meet in a shuffle. ``n`` doesn't come along.
    ``table`` is read several times, so it should be a table that was written. Null keys join nothing.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, total // most)
    frequent, others = table.where(hot).drop("n"), table.where(~hot).drop("n")
    if frequent.isEmpty():
        return rows.join(others, list(keys), how)
    rest = rows.join(F.broadcast(frequent.select(*keys)), list(keys), "left_anti").join(others, list(keys), how)
    return rows.join(F.broadcast(frequent), list(keys)).unionByName(rest)


def pin_splits(spark: SparkSession) -> None:
    """Fixes how this session cuts files into partitions, where it isn't set, so that rows numbered in one read have the
    same numbers in the next, though executors come and go in between."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to a Python worker, where it isn't set: 10,000 rows of long texts would
    lie in the executor's memory several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def kept(operator: str) -> dict:
    """What the worker keeps of ``operator`` from task to task; what it kept of another goes, since workers outlive operators."""
    if operator not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
        _KEPT[operator] = {}
    return _KEPT[operator]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``operator`` for mapInArrow, so that a worker starts without what it kept of other operators and, at the
    end of the task, returns to the system what its allocators hold free."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(operator)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return made


def text_bytes(column: str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")
