"""Substring dedup by line hashing.

Units are the lines of a text that aren't blank, and the long sentences of lines that hold several, since a passage
can recur within a longer paragraph. A unit is normalised (lower case,
runs of white space as one space, trimmed) and known by a digest of 128 bits. Digests are grouped over all
documents; of equal units the one in the earliest ranked document stays, and all others are removed. Removed
units keep the offsets they have in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import OWN, join_counted, materialize, pin_splits, rest_of

#: Words that a line must have to be a unit, and those that a sentence within a line must have.
LINE_WORDS = 1
SENTENCE_WORDS = 8
_SENTENCE = re.compile(r"\S(?:.*?[.!?](?=\s)|.*$)", re.S)


def units(text: str | None, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of each line of at least ``line_words`` words, and of each sentence of at least ``sentence_words`` in lines of several."""
    at = 0
    for line in (text or "").split("\n"):
        words = line.split()
        if words and len(words) >= line_words:
            yield at, at + len(line), " ".join(words).lower()
            found = [m.span() for m in _SENTENCE.finditer(line)]
            if len(found) > 1:
                for start, end in found:
                    words = line[start:end].split()
                    if len(words) >= sentence_words:
                        yield at + start, at + end, " ".join(words).lower()
        at += len(line) + 1


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans, which may overlap; lines that held nothing else go with their line break."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        if (start == 0 or text[start - 1] == "\n") and text[end : end + 1] == "\n":
            end += 1
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:]


def removed_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(uid, doc_id, start, end, n_words, keep_doc_id, keep_start) of each unit that goes; uid numbers the rows of ``docs`` as they are read.

    Offsets count code points. Rows are ranked by id, null ids last, and repeated ids as they are read, so of
    repeated rows the first keeps its units. Null and empty texts have no units. An empty table gives no rows.
    Other columns aren't read.
    """
    import xxhash

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for uid, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for start, end, unit in units(text, line_words, sentence_words):
                    for column, value in zip(out, (digest(unit.encode("utf-8", "surrogatepass")), uid, doc, start, end, unit.count(" ") + 1)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["digest", "uid", "id", "start", "end", "n_words"])

    pin_splits(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = materialize(rows.mapInArrow(cut, "digest binary, uid bigint, id bigint, start int, end int, n_words int"), "units")
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "start")
    first = found.groupBy("digest").agg(F.min(ranked).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("digest", F.col("first.id").alias("keep_doc_id"), F.col("first.uid").alias("keep_uid"), F.col("first.start").alias("keep_start"), "n"), "first-units")
    # a line that is very common would gather in one task, so such digests are broadcast
    return join_counted(found, first, "digest").where("uid != keep_uid or start != keep_start").select("uid", F.col("id").alias("doc_id"), "start", "end", "n_words", "keep_doc_id", "keep_start")


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """``docs`` with its texts freed of the removed units, and ``removed_spans``, their (start, end) in the original text.

    Null texts stay null. A column named removed_spans is replaced. ``docs`` is read twice, in the same order.
    """
    own, spans = f"{OWN}uid", "removed_spans"
    gone = removed_units(docs, id_col, text_col, line_words, sentence_words).groupBy(F.col("uid").alias(own)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans))

    @F.pandas_udf("string")
    def cleaned(texts, cuts):  # noqa: ANN001, ANN202
        return texts.combine(cuts, lambda t, s: t if t is None or s is None or not len(s) else without(t, [(x["start"], x["end"]) for x in s]))

    kept = rest_of(docs, spans)
    joined = docs.select(*kept, F.monotonically_increasing_id().alias(own)).join(gone, own, "left")
    empty = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    return joined.withColumn(spans, F.coalesce(spans, empty)).withColumn(text_col, F.when(F.size(spans) > 0, cleaned(F.col(f"`{text_col}`").cast("string"), F.col(spans))).otherwise(F.col(f"`{text_col}`"))).drop(own)
