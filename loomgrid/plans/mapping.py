"""Harmonisation: a declarative mapping of source columns to target columns, compiled to one select list.

A mapping holds definitions. A standard definition has rules, each with a logic and a result; the first rule that
holds gives the value. A one-hot definition has outputs, each with a logic, that become 1 or 0. Logic is written
as nested one-key objects: or, and, == (===), in, type tests and ranges of two comparisons.

In ``reference`` semantics, terms under ``and`` that are no range are alternatives, comparisons are inclusive, and
``in`` takes one value; ``strict`` semantics takes them at their word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import CONTINUOUS, any_of, date_of, dt, jtrim, num
from loomgrid.operators import rows
from loomgrid.operators.profile import text_cells

TYPES = ("integer", "double", "date")
_UNSET = object()


@dataclass(frozen=True)
class Ref:
    source: str
    column: str

    @property
    def file(self) -> str:
        return file_of(self.source)


@dataclass(frozen=True)
class Matcher:
    """A test of one column: equality with a text, a type, or a range (kind, low, high)."""

    ref: Ref
    how: str
    value: object = None
    low: object = None
    high: object = None


def file_of(source: str) -> str:
    """The file of a source id: what follows the first ``::``."""
    return source.split("::", 1)[1] if "::" in source else source


def ref_of(value: object) -> Ref | None:
    if isinstance(value, dict):
        if "var" in value:
            inner = value["var"]
            return ref_of(inner[0] if isinstance(inner, list) and inner else inner)
        if len(value) == 1 and next(iter(value)) in ("to_number", "to_date", "to_string"):
            inner = _list(next(iter(value.values())))
            return ref_of(inner[0]) if inner else None
        if value.get("sourceId") is not None and value.get("column") is not None:
            return Ref(str(value["sourceId"]), str(value["column"]))
        return None
    if not isinstance(value, str):
        return None
    source, found, column = value.strip().rpartition("::")
    return Ref(source, column) if found and source and column else None


def _literal(value: object) -> object:
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, dict) and "var" not in value:
        if "value" in value:
            return _literal(value["value"])
        if len(value) == 1 and next(iter(value)) in ("to_number", "to_date", "to_string"):
            inner = _list(next(iter(value.values())))
            return _literal(inner[0]) if inner else _UNSET
    return _UNSET


def _list(value: object) -> list:
    return list(value) if isinstance(value, list) else [] if value is None else [value]


def literal_text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _operator(logic: dict) -> tuple[str, object]:
    name, args = next(iter(logic.items()))
    return str(name).rsplit(":", 1)[-1], args  # a name space before a colon is ignored


_TYPE_TESTS = {"isInteger": "integer", "is_integer": "integer", "isDouble": "double", "is_double": "double", "isNumber": "double", "is_number": "double", "isDate": "date", "is_date": "date"}


def declared_type(logic: object) -> str | None:
    if not isinstance(logic, dict) or not logic:
        return None
    name, args = _operator(logic)
    if name == "type" and len(_list(args)) == 2:
        kind = str(_list(args)[1]).strip().lower()
        return kind if kind in TYPES else None
    return _TYPE_TESTS.get(name)


def _pair(args: object) -> tuple[Ref, object] | None:
    """A column and a literal, in either order."""
    both = _list(args)
    if len(both) == 2:
        for left, right in (both, both[::-1]):
            ref, value = ref_of(left), _literal(right)
            if ref is not None and value is not _UNSET:
                return ref, value
    return None


def _date_like(value: object) -> bool:
    return value is not None and date_of(str(value)) is not None


def _number(value: object) -> float | None:
    try:
        return float(str(value).replace(",", "."))
    except ValueError:
        return None


def range_type(low: object, high: object) -> str:
    if _date_like(low) and _date_like(high):
        return "date"
    numbers = [_number(low), _number(high)]
    return "integer" if all(x is not None and x == round(x) for x in numbers) else "double"


def _range(args: object, inclusive: bool) -> Matcher | None:
    ref, low, high, tests = None, _UNSET, _UNSET, []
    parts = _list(args)
    if len(parts) < 2:
        return None
    for part in parts:
        if not isinstance(part, dict) or not part:
            return None
        name, inner = next(iter(part.items()))
        found = _pair(inner)
        if name not in (">=", ">", "<=", "<") or found is None or (ref is not None and found[0] != ref):
            return None
        ref = found[0]
        if name[0] == ">":
            low = found[1]
        else:
            high = found[1]
        tests.append(name)
    if low is _UNSET or high is _UNSET:
        return None
    exact = "" if inclusive else ("(" if ">" in tests else "[") + (")" if "<" in tests else "]")
    return Matcher(ref, "range", (range_type(low, high), exact), low, high)


def matchers(logic: object, semantics: str = "reference") -> list:
    """The alternatives of a logic. In strict semantics an alternative may be a tuple, all parts of which must hold."""
    if not isinstance(logic, dict) or not logic:
        return []
    name, args = _operator(logic)
    strict = semantics == "strict"
    if name == "or":
        return [m for a in _list(args) for m in matchers(a, semantics)]
    if name == "and":
        own = _range(args, not strict)
        if own is not None:
            return [own]
        parts = [matchers(a, semantics) for a in _list(args)]
        return [("and", tuple(map(tuple, parts)))] if strict else [m for p in parts for m in p]
    if name in ("==", "==="):
        found = _pair(args)
        return [Matcher(found[0], "equal", None if found[1] is None else literal_text(found[1]))] if found else []
    if name == "in":
        both = _list(args)
        ref = ref_of(both[0]) if len(both) == 2 else None
        values = both[1] if len(both) == 2 and isinstance(both[1], list) else []
        if ref is None or not values or (len(values) != 1 and not strict):
            return []
        return [Matcher(ref, "equal", literal_text(v)) for v in map(_literal, values) if v is not _UNSET]
    kind, inner = declared_type(logic), _list(args)
    if kind and len(inner) == (2 if name == "type" else 1):
        ref = ref_of(inner[0])
        return [Matcher(ref, "equal", kind)] if ref else []
    if strict:
        raise ValueError(f"unknown operator {name}")
    return []


def type_test(c: Column, kind: str) -> Column:
    x = num(jtrim(c))
    if kind == "date":
        return F.coalesce(dt(jtrim(c)).isNotNull(), F.lit(False))
    whole = F.coalesce(jtrim(c).rlike(CONTINUOUS) | jtrim(c).try_cast("double").isNotNull(), F.lit(False)) & x.isNotNull()
    return whole & (x == F.floor(x)) if kind == "integer" else whole


def predicate(alternative: object, columns: list[str]) -> tuple[Column, Column | None]:
    """Whether an alternative holds, and the source cell if it is a type test (whose hit passes the raw value on)."""
    if isinstance(alternative, tuple):
        out = F.lit(True)
        for part in alternative[1]:
            out = out & any_of([predicate(m, columns)[0] for m in part])
        return out, None
    m = alternative
    if m.ref.column not in columns:
        return F.lit(False), None
    cell = F.col(f"`{m.ref.column}`").cast("string")
    if m.how == "equal":
        if m.value in TYPES:
            return type_test(cell, m.value), cell
        return F.coalesce(cell == F.lit(m.value), F.lit(False)), None
    kind, exact = m.value
    if kind == "date":
        x, low, high = dt(jtrim(cell)), dt(F.lit(str(m.low))), dt(F.lit(str(m.high)))
    else:
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (m.low, m.high)):
            raise ValueError(f"the bounds of a range of numbers must be numbers: {m.low!r}, {m.high!r}")
        x, low, high = num(cell), F.lit(float(m.low)), F.lit(float(m.high))
    above = x > low if exact.startswith("(") else x >= low
    below = x < high if exact.endswith(")") else x <= high
    return F.coalesce(above & below, F.lit(False)), None


def _applies(m: object, file: str | None, allowed: set[str] | None) -> bool:
    if isinstance(m, tuple):
        return all(any(_applies(x, file, allowed) for x in part) for part in m[1])
    return (file is None or m.ref.file == file) and (allowed is None or m.ref.column in allowed)


def _file_of_definition(mapping: dict) -> str:
    inputs = mapping.get("inputs") or []
    return mapping.get("sourceConfigFile") or (file_of(str(inputs[0].get("sourceId") or "")) if inputs else "") or "custom_mapping"


def _rules(mapping: dict, semantics: str) -> list[tuple[str, list]]:
    """(value, alternatives) of each rule; a rule that passes the source value has an empty value."""
    out = []
    for rule in mapping.get("rules") or []:
        if rule is None:
            continue
        then = rule.get("then") or {}
        passes = str(then.get("kind") or "").lower() == "source-value"
        found = matchers(rule.get("logic"), semantics)
        if not found and passes and declared_type(rule.get("logic")) and then.get("sourceId") and then.get("column"):
            found = [Matcher(Ref(str(then["sourceId"]), str(then["column"])), "equal", declared_type(rule["logic"]))]
        out.append(("" if passes else literal_text(then["value"]) if then.get("value") is not None else "", found))
    return out


def _mentions(alternatives: list, file: str) -> bool:
    return any(_applies(m, file, None) for m in alternatives)


def harmonize(df: DataFrame, spec: dict, file: str, semantics: str = "reference") -> DataFrame:
    """``df``, the rows of the file named ``file``, as the target columns of ``spec``, all text.

    A standard target starts as the column of the same name; a one-hot target is 1 or 0. Definitions that name
    another file, directly or in all of their rules, don't apply; without any that does, the result has no columns.
    """
    table = text_cells(df)
    standard: dict[str, list[tuple[str, list]]] = {}
    hot: dict[str, Column] = {}
    targets: dict[str, None] = {}  # in the order of the spec
    for mapping in spec.get("mappings") or []:
        if mapping is None:
            continue
        allowed = {i["column"] for i in mapping.get("inputs") or [] if i and i.get("column") is not None}
        if str(mapping.get("mappingType") or "").lower() == "one-hot":
            for output in mapping.get("outputs") or []:
                found = matchers((output or {}).get("logic"), semantics)
                if output and _mentions(found, file):
                    usable = [m for m in found if _applies(m, file, allowed)]
                    target = str(output.get("targetField") or "")
                    targets.setdefault(target)
                    hot[target] = F.when(any_of([predicate(m, table.columns)[0] for m in usable]), "1").otherwise("0")
            continue
        rules = _rules(mapping, semantics)
        if _file_of_definition(mapping) == file or any(_mentions(found, file) for _, found in rules):
            target = str(mapping.get("targetField") or "")
            targets.setdefault(target)
            standard[target] = [(value, [m for m in found if _applies(m, file, None)]) for value, found in rules]
    made: dict[str, Column] = dict(hot)
    for target, rules in standard.items():
        if target in hot:
            continue
        value = None
        for result, found in rules:
            for m in found:
                holds, source = predicate(m, table.columns)
                chosen = source if source is not None else F.lit(result)
                value = F.when(holds, chosen) if value is None else value.when(holds, chosen)
        same = F.coalesce(F.col(f"`{target}`"), F.lit("")) if target in table.columns else F.lit("")
        made[target] = same if value is None else value.otherwise(same)
    return table.select(*[made[t].alias(t) for t in targets])


def clean_for_mapping(df: DataFrame, order: str | None = None, empty: bool = False, duplicates: bool = False) -> DataFrame:
    """The row operators that may run before a mapping."""
    if empty:
        df = rows.remove_empty_rows(df, (order,) if order else ())
    return rows.remove_duplicates(df, order) if duplicates else df
