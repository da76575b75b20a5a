"""The corpus pipeline: toxic documents go, exact copies go, near copies go, sources are mixed, sequences are packed.

Each stage reads whole texts and keeps all columns and all rows that it doesn't reject. Nulls in any column, empty
and very long texts, repeated rows and an empty table pass through each; what becomes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm.exact_dedup import exact_dedup
from loomgrid.llm.mixing import poisson_mix
from loomgrid.llm.packing import pack_documents
from loomgrid.llm.simhash import near_dedup
from loomgrid.llm.toxicity import keep_ordinary
from loomgrid.operators.ranks import settle


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut. A null text counts as empty; repeated rows fare alike; without labels all stay."""
    return keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same bytes the one with the largest id, null ids last; of rows that repeat that id the first. Null and empty texts are equal."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a 5-word Jaccard similarity of 0.8 the row with the smallest id, null ids last. Texts without words are one group."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and its id's hash say, which may be never. A null source is a source."""
    return poisson_mix(docs).drop("copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document. A null text is an empty one, whose only token is the end."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", copies), ("near_dedup", near_copies), ("mix_sources", mixing), ("pack", packing)]

#: Scores, fingerprints and token ids aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the table that its predecessor wrote; a stage's own tables go when it's done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
