"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are brought to length one, projected to a few dimensions at random, shifted and put in the order of a
Hilbert curve; several projections and shifts give several orders. Near vectors are near to one another in at
least one of the orders: a query looks at the rows within a window around its place in each of them, and what
the windows hold is reranked by the cosine.

The width of the windows isn't guessed. The true neighbours of a bounded number of queries are found by a scan
of all rows, and the window is made as wide as it must be for the wanted share of these neighbours to lie
within it in at least one order. So recall holds for vectors without any structure too, where no order helps
and the windows grow with the table, while clustered vectors get small windows.

Equal vectors are one row of the index. Orders are range-partitioned, ranks come from counts for each
partition, and windows are met block by block of ranks, so a vector that is very common doesn't gather.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize

CURVES = 8
DIMENSIONS = 6
BITS = 10
NEIGHBOURS = 5
#: Queries whose true neighbours set the window, and the share of these neighbours that must lie within it.
TRIED = 100
RECALL = 0.97
#: Ranks in a block, and queries that meet a block at once.
BLOCK = 2048
MEETING = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, from 0 to 2**bits - 1), by Gray-code transposition."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= np.where(high, 0, swap) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.int64(1) << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys of vectors of length one in the order number ``curve``: its own projection and shift."""
    rng = np.random.default_rng([curve, unit.shape[1]])
    wide = rng.standard_normal((unit.shape[1], dimensions))
    basis = np.linalg.qr(wide)[0] if unit.shape[1] >= dimensions else wide
    spread = 4 / np.sqrt(unit.shape[1])  # four standard deviations of a coordinate of a random direction
    cells = (unit @ basis / (2 * spread) + 0.5 + rng.uniform(-0.25, 0.25, dimensions)) * (1 << bits)
    return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: exact, so no
    cosine changes, and no square of a finite component leaves the range of doubles."""
    rows = rows.astype(np.float64)
    power = np.frexp(np.abs(rows).max(1, initial=0))[1]
    half = power // 2  # in two steps, as 2 ** -power itself may be out of range
    return np.ldexp(np.ldexp(rows, -half[:, None]), (half - power)[:, None])


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query with each row, in double precision, for vectors of any finite size but zero."""
    a, b = scaled(queries), scaled(rows)
    return np.clip((a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]), -1, 1)


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, ids): each distinct vector that takes part, as doubles, and the smallest ids that have it."""
    array = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.expr("vec is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vec, x -> x != 0)")
    return table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), array.alias("vec")).where(usable & F.col("id").isNotNull())


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for q in range(len(scores)):
        row = scores[q]
        if len(row) > k:
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        else:
            near = np.arange(len(row))
        yield q, near[np.lexsort((ids[near], -row[near]))][:k]


def _ranked(index: DataFrame, curves: int, dimensions: int, bits: int) -> DataFrame:
    """(curve, rank, node): the place of each row of the index in each order."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
            unit = scaled(vec)
            unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
            for curve in range(curves):
                key = curve_keys(unit, curve, dimensions, bits) if len(unit) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve, np.int32)), pa.array(key), batch.column(0)], ["curve", "key", "node"])

    keyed = index.select("node", "vec").mapInArrow(keys, "curve int, key bigint, node bigint")
    ordered = keyed.repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            place = []
            for curve in batch.column(0).to_pylist():
                place.append(seen.get(curve, 0))
                seen[curve] = place[-1] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), pa.array(place, pa.int64()), batch.column(2)], ["curve", "part", "place", "node"])

    placed = materialize(ordered.mapInArrow(number, "curve int, part int, place bigint, node bigint"), "places")
    counts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("curve", "part", before.alias("before")), "starts")
    return placed.join(starts, ["curve", "part"]).select("curve", (F.col("before") + F.col("place")).alias("rank"), "node")


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = NEIGHBOURS, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, tried: int = TRIED, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Nearest first, by the cosine in double precision, ties to the smaller id; the query's own row is no
    candidate, but rows with the same vector are. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do null ids; vectors of another length than a query's are no
    candidates. Of rows that repeat an id the id counts once for each distinct vector. An empty table gives no rows.
    """
    rows = _vectors(table, id_col, vector_col)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a very common vector leaves a batch with its k + 1 smallest ids
            frame = pd.DataFrame({"id": batch.column(0).to_numpy(), "vec": [v.tobytes() for v in batch.column(1).to_numpy(zero_copy_only=False)]})
            low = frame.drop_duplicates().sort_values("id").groupby("vec", sort=False)["id"].apply(lambda x: x.tolist()[: k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(low.index.to_list(), pa.binary()), pa.array(low.to_list(), pa.list_(pa.int64()))], ["vec", "ids"])

    packed = rows.mapInArrow(local, "vec binary, ids array<bigint>")
    grouped = packed.groupBy("vec").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {k + 1})").alias("ids"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc_first(batch.column(1)), pa.array([np.frombuffer(v, np.float64) for v in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["node", "vec", "ids"])

    def pc_first(lists: pa.Array) -> pa.Array:
        return pa.array([x[0] for x in lists.to_pylist()], pa.int64())

    index = materialize(grouped.mapInArrow(unpacked, "node bigint, vec array<double>, ids array<bigint>"), "vectors")
    sizes = [r[0] for r in index.select(F.size("vec")).distinct().orderBy(F.size("vec")).collect()]  # one for each length of vectors
    asked = rows.where(F.col("id") % every == 0).select("id", "vec")
    out = None
    for size in sizes:
        own = _nearest(index.where(F.size("vec") == size), asked.where(F.size("vec") == size), k, curves, dimensions, bits, tried, recall, block)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _nearest(index: DataFrame, asked: DataFrame, k: int, curves: int, dimensions: int, bits: int, tried: int, recall: float, block: int) -> DataFrame:
    # node, the smallest id of a vector, names the vector; a query may be another of its ids
    nodes = index.select("node", "ids")
    owners = materialize(asked.join(index.select("vec", "node"), "vec").select("id", "node"), "queries")
    where = materialize(_ranked(index, curves, dimensions, bits), "ranks")
    width = _window(index, owners, where, k, tried, recall)
    at = where.join(owners, "node").select("curve", "node", "rank").distinct()
    low, high = F.greatest(F.col("rank") - width, F.lit(0)), F.col("rank") + width
    reach = at.select("curve", F.col("node").alias("query"), F.explode(F.sequence((low / block).cast("bigint"), (high / block).cast("bigint"))).alias("block"))
    slots = max(1, -(-(2 * width + block) // (50 * MEETING)))  # a block meets its queries in portions if the windows are wide
    reach = reach.withColumn("slot", F.pmod(F.xxhash64("query"), F.lit(slots)).cast("int")).select("curve", "block", "slot", F.col("query").alias("node"), F.lit(True).alias("asks"))
    held = where.select("curve", (F.col("rank") / block).cast("bigint").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "node", F.lit(False).alias("asks"))
    filled = reach.unionByName(held).join(index.select("node", "vec"), "node")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        queries, rows = frame[asks], frame[~asks]
        found = []
        if len(queries) and len(rows):
            ids, matrix = rows["node"].to_numpy(), np.stack(rows["vec"].to_list())
            for first in range(0, len(queries), 512):
                part = queries.iloc[first : first + 512]
                scores = cosines(np.stack(part["vec"].to_list()), matrix)
                for q, near in _top(scores, ids, k + 1):
                    found.append(pd.DataFrame({"query": part["node"].iloc[q], "node": ids[near], "score": scores[q][near]}))
        return pd.concat(found) if found else pd.DataFrame({"query": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    met = filled.groupBy("curve", "block", "slot").applyInPandas(meet, "query bigint, node bigint, score double")
    # one score for each pair, though two windows met it: equal sums can differ in the last bit between blocks.
    # A query's own vector lies in its window, so rows that have the same vector get their score by the same rule.
    merged = met.groupBy("query", "node").agg(F.max("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("r") <= k + 1)
    expanded = best.join(owners.select(F.col("node").alias("query"), F.col("id").alias("query_id")), "query").join(nodes, "node")
    pairs = expanded.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _window(index: DataFrame, owners: DataFrame, where: DataFrame, k: int, tried: int, recall: float) -> int:
    """How many ranks to either side hold the share ``recall`` of the true neighbours of ``tried`` queries in at least one order."""
    trial = owners.select("node").distinct().orderBy(F.xxhash64("node"), "node").limit(tried)
    queries = index.join(F.broadcast(trial), "node").select("node", "vec").toPandas()  # at most `tried` rows
    if not len(queries):
        return 1
    ids, matrix = queries["node"].to_numpy(), np.stack(queries["vec"].to_list())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                scores = cosines(matrix, np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
                scores[ids[:, None] == own[None, :]] = -np.inf
                found = [(ids[q], own[j], scores[q][j]) for q, near in _top(scores, own, k) for j in near if scores[q][j] > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query", "node", "score"])

    near = index.select("node", "vec").mapInArrow(scan, "query bigint, node bigint, score double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("r") <= k).select("query", "node")
    best = materialize(best, "true-neighbours")
    here = where.join(F.broadcast(best.select("node").union(best.select(F.col("query").alias("node"))).distinct()), "node")  # at most tried * (k + 1) rows
    a = best.join(here, "node").select("query", "node", "curve", F.col("rank").alias("a"))
    b = here.select(F.col("node").alias("query"), "curve", F.col("rank").alias("b"))
    apart = a.join(b, ["query", "curve"]).groupBy("query", "node").agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("d"))
    distances = sorted(r["d"] for r in apart.collect())  # at most tried * k rows
    return int(distances[min(len(distances) - 1, int(np.ceil(recall * len(distances))) - 1)]) + 1 if distances else 1
