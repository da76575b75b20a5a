"""Sharing of files: fingerprints, families of files, and the manifest of what may be downloaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.metadata import group_name, slug

MANIFEST = "fingerprint string, dataset string, name string"


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(name, dataset, fingerprint) of a folder's files: SHA-256 of their bytes, and the family that they belong to."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), logical_id(name).alias("dataset"), F.sha2("content", 256).alias("fingerprint"))


def logical_id(name: Column) -> Column:
    return slug(group_name(name))


def share(manifest: DataFrame, files: DataFrame, dataset: str) -> DataFrame:
    """The manifest with all files of a family."""
    family = files.where(F.col("dataset") == dataset).select("fingerprint", "dataset", "name")
    return manifest.join(family.select("fingerprint"), "fingerprint", "left_anti").unionByName(family)


def unshare(manifest: DataFrame, dataset: str) -> DataFrame:
    return manifest.where(F.col("dataset") != dataset)


def seed(manifest: DataFrame, files: DataFrame, selectors: DataFrame, seeded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest with the families of selectors (selector) that weren't seeded before, and what is seeded now."""
    new = selectors.join(seeded, "selector", "left_anti")
    chosen = files.join(new.select(logical_id(F.col("selector")).alias("dataset")).distinct(), "dataset", "left_semi").select("fingerprint", "dataset", "name")
    return manifest.unionByName(chosen.join(manifest.select("fingerprint"), "fingerprint", "left_anti")), seeded.unionByName(new)


def downloadable(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose contents the manifest allows, whatever they are called."""
    return files.join(manifest.select("fingerprint").distinct(), "fingerprint", "left_semi")


def renamed(manifest: DataFrame, fingerprint: str, name: str) -> DataFrame:
    """The manifest after a rename: the entry follows the contents."""
    own = F.col("fingerprint") == fingerprint
    return manifest.withColumn("name", F.when(own, F.lit(name)).otherwise(F.col("name")))


def deleted(manifest: DataFrame, fingerprint: str) -> DataFrame:
    return manifest.where(F.col("fingerprint") != fingerprint)


def inherited(manifest: DataFrame, source: str, fingerprint: str, name: str) -> DataFrame:
    """The manifest with a derived file, if its source is in it: the file joins the source's family."""
    own = manifest.where(F.col("fingerprint") == source).select(F.lit(fingerprint).alias("fingerprint"), "dataset", F.lit(name).alias("name"))
    return manifest.where(F.col("fingerprint") != fingerprint).unionByName(own)
