"""The cleaning pipeline: one record of options, eight stages in a fixed order, one lazy plan.

Each run of scalar functions is one projection over all text columns. Only dedupe, fills, scaling and merging of
similar values shuffle or scan again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import numeric, text
from loomgrid.operators import columns as cols
from loomgrid.operators import fill, fuzzy, rows
from loomgrid.operators.profile import text_cells
from loomgrid.operators.ranks import scratch


@dataclass
class CleaningOptions:
    """The 36 switches and their arguments; :meth:`from_json` reads the camel-case names of a request."""

    remove_duplicates: bool = False
    remove_empty_rows: bool = False
    trim_whitespace: bool = False
    standardize_dates: bool = False
    date_output_format: str | None = None
    extract_date_components: bool = False
    standardize_numeric: bool = False
    numeric_columns: list[str] = field(default_factory=list)
    numeric_mode: str = ""
    remove_leading_zeros: bool = False
    round_decimals: bool = False
    decimal_places: int = 0
    standardize_case: bool = False
    case_mode: str = ""
    normalize_text: bool = False
    remove_special_characters: bool = False
    special_char_columns_pattern: str | None = None
    remove_punctuation: bool = False
    remove_extra_spaces: bool = False
    remove_line_breaks: bool = False
    fill_missing_values: bool = False
    fill_strategy: str = ""
    fill_constant_value: str = ""
    fill_columns: list[str] = field(default_factory=list)
    replace_values: bool = False
    replacement_map: dict[str, str] = field(default_factory=dict)
    strip_prefix: bool = False
    prefix_to_strip: str | None = None
    strip_suffix: bool = False
    suffix_to_strip: str | None = None
    pad_values: bool = False
    pad_direction: str = "right"
    pad_length: int = 0
    pad_character: str = " "
    convert_data_types: bool = False
    type_conversion_map: dict[str, str] = field(default_factory=dict)
    extract_email_domain: bool = False
    validate_emails: bool = False
    extract_url_components: bool = False
    normalize_urls: bool = False
    standardize_phone_numbers: bool = False
    phone_format: str = "national"
    default_country_code: str = "+1"
    fix_encoding: bool = False
    remove_non_printable_chars: bool = False
    normalize_unicode: bool = False
    unicode_normalization: str = "NFC"
    split_column: bool = False
    column_to_split: str | None = None
    split_delimiter: str = ","
    new_column_names: list[str] = field(default_factory=list)
    merge_columns: bool = False
    columns_to_merge: list[str] = field(default_factory=list)
    merge_delimiter: str = " "
    merged_column_name: str = "merged_column"
    remove_rows_with_pattern: bool = False
    row_filter_pattern: str | None = None
    row_filter_column: str | None = None
    keep_only_numeric_rows: bool = False
    numeric_validation_columns: list[str] = field(default_factory=list)
    normalize_data: bool = False
    normalize_columns: list[str] = field(default_factory=list)
    standardize_data: bool = False
    standardize_columns: list[str] = field(default_factory=list)
    bin_data: bool = False
    bin_column: str | None = None
    bin_edges: list[float] = field(default_factory=list)
    bin_labels: list[str] = field(default_factory=list)
    merge_similar_values: bool = False
    fuzzy_match_columns: list[str] = field(default_factory=list)
    merge_similarity_algorithm: str = "levenshtein"
    merge_similarity_threshold: float = 0.85
    merge_case_insensitive: bool = False
    merge_trim_values: bool = False
    merge_preferred_value: str = "most_frequent"

    @classmethod
    def from_json(cls, options: dict) -> CleaningOptions:
        known = {f.name for f in fields(cls)}
        snake = lambda k: re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", k).lower()
        given = {("normalize_urls" if k == "normalizeURLs" else "extract_url_components" if k == "extractURLComponents" else snake(k)): v for k, v in options.items()}
        return cls(**{k: v for k, v in given.items() if k in known and v is not None})

    @property
    def any(self) -> bool:
        return any(getattr(self, f.name) is True for f in fields(self) if f.type == "bool" and not f.name.startswith("merge_case") and f.name != "merge_trim_values")


def column_id(name: str) -> str:
    """A column's name without a source prefix ``source:::``."""
    return name.rsplit(":::", 1)[-1]


def clean(df: DataFrame, options: CleaningOptions, order: str | None = None) -> DataFrame:
    """``df`` as text cells, cleaned. ``order`` is a column that isn't cleaned and gives the order of rows, which the
    fills by neighbours and merges need; without any switch the table is returned as it is."""
    if not options.any:
        return df
    names = [c for c in df.columns if c != order]
    table = text_cells(df, names) if order is None else df.select(F.col(f"`{order}`"), *_text(df, names))
    for stage in (_rows, _strings, _texts, _dates_and_numbers, _addresses, _columns, _statistics, _similar):
        table = stage(table, options, order)
        if stage is _rows and options.remove_duplicates and _scans_again(options):
            table = scratch(table, "distinct")  # the shuffle of whole rows runs once, not once for each statistic
    return table


def _scans_again(o: CleaningOptions) -> bool:
    """Whether a later stage needs statistics of the whole table before it can write its rows."""
    fills = o.fill_missing_values and o.fill_strategy.strip().lower() not in ("", "constant")
    return fills or o.normalize_data or o.standardize_data or (o.merge_similar_values and bool(o.fuzzy_match_columns))


def _text(df: DataFrame, names: list[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [(F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd HH:mm:ss") if kinds[c].startswith("timestamp") else F.col(f"`{c}`").cast("string")).alias(c) for c in names]


def _cells(df: DataFrame, order: str | None) -> list[str]:
    return [c for c in df.columns if c != order]


def _rows(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    if o.remove_empty_rows:
        df = rows.remove_empty_rows(df, (order,) if order else ())
    if o.remove_duplicates:
        df = rows.remove_duplicates(df, order)
    if o.remove_rows_with_pattern:
        df = rows.remove_rows_with_pattern(df, o.row_filter_column, o.row_filter_pattern)
    if o.keep_only_numeric_rows:
        df = rows.keep_only_numeric_rows(df, [column_id(c) for c in o.numeric_validation_columns])
    return df


def _mapped(df: DataFrame, order: str | None, functions: list) -> DataFrame:  # noqa: ANN001
    """All functions over all cells, a projection for each: nested into one another, functions that name their input
    several times would grow the plan by that factor each. Spark merges the projections where that costs nothing."""
    for f in functions:
        df = cols.each(df, _cells(df, order), f)
    return df


def _strings(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    todo = []
    if o.replace_values and o.replacement_map:
        todo.append(lambda c: text.replace_values(c, o.replacement_map))
    if o.strip_prefix and o.prefix_to_strip is not None:
        todo.append(lambda c: text.strip_prefix(c, o.prefix_to_strip))
    if o.strip_suffix and o.suffix_to_strip is not None:
        todo.append(lambda c: text.strip_suffix(c, o.suffix_to_strip))
    if o.pad_values:
        todo.append(lambda c: text.pad(c, o.pad_length, o.pad_character, o.pad_direction))
    df = _mapped(df, order, todo)
    if o.fill_missing_values and o.fill_strategy.strip():
        df = fill.fill_missing(df, o.fill_strategy.strip(), o.fill_columns or _cells(df, order), o.fill_constant_value or "", order)
    return df


def _texts(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    todo = [f for wanted, f in ((o.trim_whitespace, text.trim), (o.remove_extra_spaces, text.squeeze), (o.remove_line_breaks, text.join_lines), (o.normalize_text, text.squeeze)) if wanted]
    if o.standardize_case and o.case_mode.strip():
        todo.append(lambda c: text.case(c, o.case_mode.strip()))
    todo += [f for wanted, f in ((o.remove_special_characters, text.drop_special), (o.remove_punctuation, text.drop_punctuation), (o.remove_non_printable_chars, text.drop_unprintable), (o.fix_encoding, text.fix_encoding)) if wanted]
    if o.normalize_unicode:
        todo.append(lambda c: text.unicode_form(c, o.unicode_normalization))
    return _mapped(df, order, todo)


def _dates_and_numbers(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    if o.standardize_dates:
        df = _mapped(df, order, [lambda c: numeric.standard_date(c, o.date_output_format)])
    if o.extract_date_components:
        df = cols.with_date_parts(df, _cells(df, order))
    if o.standardize_numeric and o.numeric_columns and o.numeric_mode.strip():
        df = cols.each(df, [column_id(c) for c in o.numeric_columns], lambda c: numeric.standard_number(c, o.numeric_mode.strip()))
    todo = [text.drop_leading_zeros] if o.remove_leading_zeros else []
    if o.round_decimals:
        todo.append(lambda c: numeric.round_decimals(c, o.decimal_places))
    return _mapped(df, order, todo)


def _addresses(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    if o.extract_email_domain:
        df = cols.with_email_domains(df, _cells(df, order))
    if o.validate_emails:
        df = _mapped(df, order, [text.valid_email])
    if o.extract_url_components:
        df = cols.with_url_parts(df, _cells(df, order))
    todo = [text.normal_url] if o.normalize_urls else []
    if o.standardize_phone_numbers:
        todo.append(lambda c: text.phone(c, o.phone_format, o.default_country_code or "+1"))
    return _mapped(df, order, todo)


def _columns(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    if o.split_column and o.column_to_split:
        df = cols.split_column(df, o.column_to_split, o.split_delimiter, o.new_column_names)
    if o.merge_columns and o.columns_to_merge:
        df = cols.merge_columns(df, o.columns_to_merge, o.merge_delimiter if o.merge_delimiter is not None else " ", o.merged_column_name or "merged_column")
    if o.convert_data_types and o.type_conversion_map:
        df = cols.convert_types(df, o.type_conversion_map)
    return df


def _statistics(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    present = lambda names: [c for c in map(column_id, names) if c in df.columns]
    if o.normalize_data:
        df = fill.min_max(df, present(o.normalize_columns))
    if o.standardize_data:
        df = fill.z_score(df, present(o.standardize_columns))
    if o.bin_data and o.bin_column:
        df = cols.bin_column(df, o.bin_column, o.bin_edges, o.bin_labels)
    return df


def _similar(df: DataFrame, o: CleaningOptions, order: str | None) -> DataFrame:
    if not (o.merge_similar_values and o.fuzzy_match_columns):
        return df
    if order is None:
        raise ValueError("merging similar values needs an order column")
    names = [column_id(c) for c in o.fuzzy_match_columns]
    return fuzzy.merge_similar_values(df, names, order, o.merge_similarity_algorithm, o.merge_similarity_threshold, o.merge_case_insensitive, o.merge_trim_values, o.merge_preferred_value)
