"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import OWN


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(labels: DataFrame, id_col: str, label_col: str, learns: Column, most: int) -> DataFrame:
    """(id, label) of at most ``most`` ids of each label among the rows of ``labels`` that meet ``learns``.

    The ids with the least hashes are taken, so the sample doesn't depend on how the table is dealt. Null ids
    and labels aren't used; an id with several labels counts as the largest.
    """
    known = labels.where(learns & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    known = known.groupBy(F.col(f"`{id_col}`").cast("bigint").alias(f"{OWN}id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    order = [F.xxhash64(F.lit(7), f"{OWN}id"), f"{OWN}id"]
    return known.where("label = 1").orderBy(*order).limit(most).unionByName(known.where("label = 0").orderBy(*order).limit(most))


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text and the columns of ``sample``): the text of each id of ``sample``, which is broadcast, as it's bounded.

    Of rows with the same id and different texts the least text counts, so that the result is bounded as well.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias(f"{OWN}id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), f"{OWN}id")
    return texts.groupBy(*sample.columns).agg(F.min("text").alias("text"))
