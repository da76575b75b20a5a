"""The stateless part of the cleaning pipeline over streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from loomgrid.plans.cleaning import CleaningOptions, clean

#: Switches that need more than the row itself, or all rows, and so can't run on a stream.
STATEFUL = ("remove_duplicates", "normalize_data", "standardize_data", "merge_similar_values")


def clean_stream(stream: DataFrame, options: CleaningOptions) -> DataFrame:
    """A stream cleaned row by row; options that need other rows are refused, but for fills by a constant."""
    asked = [s for s in STATEFUL if getattr(options, s)]
    if options.fill_missing_values and options.fill_strategy != "constant":
        asked.append(f"fill_missing_values by {options.fill_strategy}")
    if options.split_column and not options.new_column_names:
        asked.append("split_column without new_column_names")
    if asked:
        raise ValueError(f"not on a stream: {', '.join(asked)}")
    return clean(stream, replace(options))
