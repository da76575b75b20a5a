"""Filter trees compiled to one predicate.

    filter   := {"operator": "AND" | "OR", "conditions": {feature: criteria}}
    criteria := "text" | ["a", "b"] | {"conditions": [condition], "operators": ["AND" | "OR"]}
    condition := {"type": "equal" | "greater" | "less" | "between", "filterType": "categorical" | "continuous" | "date", "value": v | [lo, hi]}
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import all_of, any_of, blank, date_of, dt, num_de

_SUFFIX = re.compile(r" \([^()]*\.(?:csv|xlsx)\)$")
_KINDS = ("categorical", "continuous", "date")


class FilterError(ValueError):
    """A filter that can't be compiled."""


def feature_of(name: str) -> str:
    """A feature's name without a trailing file name in brackets."""
    return _SUFFIX.sub("", name)


def compile_filter(tree: dict | None, columns: list[str]) -> Column:
    """The predicate of a filter tree, never null. A tree without a text operator accepts all rows; an unknown operator accepts none."""
    operator = (tree or {}).get("operator")
    if not isinstance(operator, str):
        return F.lit(True)
    terms = [_criteria(feature_of(name), criteria, columns) for name, criteria in ((tree or {}).get("conditions") or {}).items() if criteria is not None]
    if operator.upper() == "AND":
        return all_of(terms)
    if operator.upper() == "OR":
        return any_of(terms)
    return F.lit(False)


def filter_rows(df: DataFrame, tree: dict | None) -> DataFrame:
    return df.where(compile_filter(tree, df.columns))


def _cell(name: str, columns: list[str]) -> Column:
    return F.col(f"`{name}`").cast("string") if name in columns else F.lit(None).cast("string")


def _criteria(name: str, criteria: object, columns: list[str]) -> Column:
    cell = _cell(name, columns)
    if isinstance(criteria, str):
        return F.coalesce(cell == F.lit(criteria), F.lit(False))
    if isinstance(criteria, (list, tuple)):
        values = [_text(v) for v in criteria if v is not None]
        return F.coalesce(cell.isin(values), F.lit(False)) if values else F.lit(False)
    if isinstance(criteria, dict):
        return _chain(cell, criteria)
    raise FilterError("Invalid filter criteria format")


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _chain(cell: Column, criteria: dict) -> Column:
    """Conditions joined strictly from left to right; an unknown operator ignores its term."""
    conditions, operators = criteria.get("conditions"), criteria.get("operators")
    if "type" in criteria and "filterType" not in criteria and conditions is None:
        raise FilterError("Missing type or filterType in condition")
    if not isinstance(conditions, list) or not conditions or not isinstance(operators, list):
        return F.lit(False)
    terms = [_condition(cell, c) for c in conditions]
    out = terms[0]
    for operator, term in zip(operators, terms[1:]):
        if str(operator).upper() == "AND":
            out = out & term
        elif str(operator).upper() == "OR":
            out = out | term
    return out


def _condition(cell: Column, condition: dict) -> Column:
    kind, wanted, value = condition.get("type"), condition.get("filterType"), condition.get("value")
    if kind is None or wanted is None:
        raise FilterError("Missing type or filterType in condition")
    if str(wanted).lower() not in _KINDS:
        return F.lit(False)
    kind = str(kind).lower()
    if str(wanted).lower() == "categorical":
        found = cell == F.lit(_text(value)) if kind == "equal" else F.lit(False)
    elif kind == "between":
        bounds = value if isinstance(value, (list, tuple)) else []
        found = _compared(cell, bounds[0], ">=") & _compared(cell, bounds[1], "<=") if len(bounds) == 2 else F.lit(False)
    else:
        found = {"equal": lambda: _compared(cell, value, "=="), "greater": lambda: _compared(cell, value, ">"), "less": lambda: _compared(cell, value, "<")}.get(kind, lambda: F.lit(False))()
    return F.coalesce(~blank(cell) & found, F.lit(False))


def _compared(cell: Column, value: object, how: str) -> Column:
    """By dates if both sides are dates, else by German numbers; false if neither can be read."""
    test = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[how]
    day, numbers = date_of(_text(value)), test(num_de(cell), num_de(F.lit(_text(value))))
    if day is None:
        return F.coalesce(numbers, F.lit(False))
    return F.coalesce(F.when(dt(cell).isNotNull(), test(dt(cell), F.lit(day).cast("timestamp"))).otherwise(numbers), F.lit(False))
