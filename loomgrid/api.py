"""What a user of the library calls: profiles, filtered profiles, cleaning and harmonising of files."""

from __future__ import annotations

import posixpath
import warnings

from pyspark.sql import DataFrame, SparkSession

from loomgrid.operators.filters import filter_rows
from loomgrid.operators.profile import CATEGORY, DATE, NUMBER, feature_name, profile
from loomgrid.plans.cleaning import CleaningOptions, clean
from loomgrid.plans.mapping import clean_for_mapping, harmonize
from loomgrid.sources import sinks
from loomgrid.sources.tables import ROW, exists, is_huge, read_table
from loomgrid.streaming.jobs import Jobs


def profile_file(spark: SparkSession, path: str, filter_tree: dict | None = None, overrides: dict[str, str] | None = None) -> dict[str, DataFrame] | str:
    """The profile of a file; with a filter, of the rows that meet it, and then percentages refer to rows. A message if there are none."""
    table = read_table(spark, path)
    if filter_tree is not None:
        table = filter_rows(table, filter_tree)
    if table.isEmpty():
        return "No matching records" if filter_tree is not None else "No records"
    return profile(table, ROW, total="cells" if filter_tree is None else "rows", overrides=overrides)


def profile_files(spark: SparkSession, paths: list[str], filters: dict[str, dict] | None = None) -> list:
    """The profile of each file, in order; a file that can't be profiled gives its error's message."""
    out = []
    for path in paths:
        try:
            out.append(profile_file(spark, path, (filters or {}).get(posixpath.basename(path))))
        except Exception as error:
            out.append(str(error))
    return out


def reprofile_file(spark: SparkSession, path: str, feature: str, kind: str) -> dict[str, DataFrame] | str:
    """The profile of one feature that is forced to be continuous or categorical; a message if it can't be.

    A column of dates stays one when it's forced to be continuous.
    """
    from pyspark.sql import functions as F

    table = read_table(spark, path)
    columns = [c for c in table.columns if c != ROW and feature_name(c) == feature]
    if not columns:
        return f"No feature {feature}"
    if kind == NUMBER and profile(table, ROW, columns, "rows")["types"].where(F.col("kind") == DATE).count():
        return profile(table, ROW, columns, "rows")
    out = profile(table, ROW, columns, "rows", {feature: kind})
    if kind == CATEGORY and not out["omitted"].isEmpty():
        return "This field cannot be converted to categorical."
    return out


def profile_or_start(spark: SparkSession, jobs: Jobs, paths: list[str]):  # noqa: ANN201
    """The profiles, or the name of a background job if a file is huge."""
    if any(is_huge(spark, p) for p in paths):
        return jobs.start(lambda report: profile_files(spark, paths))
    return profile_files(spark, paths)


def clean_file(spark: SparkSession, path: str, options: CleaningOptions | dict, report=lambda percent, message="": None) -> str:  # noqa: ANN001
    """Cleans a file in place (a workbook into a csv beside it) and returns the path of the result."""
    options = options if isinstance(options, CleaningOptions) else CleaningOptions.from_json(options)
    if not options.any:
        return path
    report(10, "reading")
    table = read_table(spark, path)
    report(50, "cleaning")
    cleaned = clean(table, options, ROW)
    target = sinks.cleaned_path(path)
    report(85, "writing")
    sinks.write_file(cleaned, target)
    report(100, "done")
    return target


def harmonize_files(spark: SparkSession, paths: list[str], spec: dict, options: CleaningOptions | None = None, semantics: str = "reference", report=lambda percent, message="": None) -> list[str]:  # noqa: ANN001
    """Writes parsed_<stem>.csv for each file that exists and returns the paths; the first four cleaning switches apply before the mapping."""
    options, out = options or CleaningOptions(), []
    for k, path in enumerate(paths):
        if not exists(spark, path):
            warnings.warn(f"{path} doesn't exist and is left out", stacklevel=2)
            continue
        table = clean_for_mapping(read_table(spark, path), ROW, options.remove_empty_rows, options.remove_duplicates)
        if options.standardize_dates or options.standardize_numeric:
            table = clean(table, CleaningOptions(standardize_dates=options.standardize_dates, date_output_format=options.date_output_format, standardize_numeric=options.standardize_numeric, numeric_columns=options.numeric_columns, numeric_mode=options.numeric_mode), ROW)
        target = sinks.parsed_path(path)
        sinks.write_file(harmonize(table, spec, posixpath.basename(path), semantics), target, keep_if_empty=False)
        out.append(target)
        report(100 * (k + 1) // len(paths), posixpath.basename(path))
    return out
