"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents longer than a sequence are cut into full sequences and a rest. The rests meet in a histogram with one
entry for each length; lengths are placed longest first into the packs that have the most room, whole groups
of equal packs at a time, so the work depends on the lengths there are and not on the documents. What comes
out is, for each length, a list of runs: documents with ranks from ``first`` on go to consecutive sequences at
one offset. Documents are ranked within their length by counts for each task, so no length gathers in one task.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import bound_batches, lean, materialize
from loomgrid.llm.tokens import WORD_BPE, lookup

LENGTH = 4096
END = 2
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, place bigint"


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Runs of each length, as (first rank, first sequence, offset) by rank, and the number of sequences.

    Shortest pack first: the pack with the most room takes the next longest length; a new pack is opened if
    none has enough room. Lengths must be from 1 to ``length``. Ties go to the pack that was opened first.
    """
    room: list[tuple[int, int]] = []  # (-room, number of the group)
    groups: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}  # number -> packs, and their (length, first rank, offset)
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    made = 0

    def put(left: int, packs: int, runs: list[tuple[int, int, int]]) -> None:
        nonlocal made
        if left == 0:
            done.append((packs, runs))
            return
        heapq.heappush(room, (-left, made))
        groups[made] = (packs, runs)
        made += 1

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        if not 0 < size <= length:
            raise ValueError(f"a length of {size} doesn't fit into {length}")
        rank, left = 0, counts[size]
        while left:
            if room and -room[0][0] >= size:
                space, number = heapq.heappop(room)
                packs, runs = groups.pop(number)
                if packs > left:  # the rest of the group stays as it is
                    heapq.heappush(room, (space, number))
                    groups[number] = (packs - left, [(s, r + left, o) for s, r, o in runs])
                    packs = left
                put(-space - size, packs, [*runs, (size, rank, length + space)])
                rank, left = rank + packs, left - packs
            else:  # a new pack has the most room until it can't take another of this length
                each = min(left, length // size)
                packs = left // each
                put(length - each * size, packs, [(size, rank + k * packs, k * size) for k in range(each)])
                rank, left = rank + each * packs, left - each * packs
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequences = 0
    for packs, runs in [*done, *(groups[k] for k in sorted(groups))]:
        for size, rank, offset in runs:
            out[size].append((rank, sequences, offset))
        sequences += packs
    return {size: sorted(runs) for size, runs in out.items()}, sequences


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, end: int) -> DataFrame:
    """The pieces of each document, with their place among the pieces of the same length of the same task."""
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = lookup(tokenizer, "bytes"), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join(own.each(text or "")) + last
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    n = len(piece) // 4
                    rows.append((doc, start, n, zlib.crc32(piece), total, task, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(cut, "tokens"), _PIECES)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each row of ``docs``.

    A document is its ids and ``end``; null texts are empty ones, so each has one id at least. Pieces but the
    last are full sequences. A repeated row is one more document. An empty table gives no rows. Other columns
    aren't read. A sequence with less than ``length`` ids is padded when it's used, unless it has a power of
    two of them.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, id_col, text_col, tokenizer, length, end), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(by_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    runs, _ = pack_histogram(counts, length)
    # A few runs for each length, whatever the number of documents: at most `length` lengths, and each splits one group.
    table = spark.sparkContext.broadcast({size: tuple(map(list, zip(*r))) for size, r in runs.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = table.value
        for batch in batches:
            sequence, offset = [], []
            for size, rank in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                first, start, at = runs_of[size]
                k = bisect_right(first, rank) - 1
                sequence.append(start[k] + rank - first[k])
                offset.append(at[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # starts has a row for each task and length, so it grows with the input and isn't broadcast
    ranked = pieces.join(starts.hint("merge"), ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
