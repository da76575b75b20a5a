"""Parsers and tests that all operators share, as column expressions without any UDF.

Text cells are parsed in two ways: ``num`` accepts a decimal comma or point and falls back to ``num_de``, which
reads a German number from the beginning of a text and ignores what follows; ``dt`` tries fixed patterns.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"( \d{2}:\d{2}:\d{2})?\z"
_YEAR_FIRST = r"^(\d{4})([./-])(\d{2})\2(\d{2})" + _TIME
_YEAR_LAST = r"^(?:(\d{1,2})([./])(\d{2})\2|(\d{2})([./])(\d)\5|(\d{2})-(\d{2})-)(\d{4})" + _TIME
_SHORT_YEAR = r"^(\d{2})([./])(\d{2})\2(\d{2})" + _TIME
_ISO_MILLIS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"
CONTINUOUS = r"^-?\d+([.,]\d+)?$"
EMAIL = r"([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
URL = r"^(https?://)([^/]+)(/[^?]*)?(\?.*)?$"


def jtrim(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(c: Column) -> Column:
    """Null or nothing but characters up to U+0020; never null."""
    return c.isNull() | c.rlike(r"^[\x00-\x20]*\z")


def missing(c: Column) -> Column:
    """Blank, or the word NULL in any case; never null."""
    return blank(c) | F.coalesce(F.upper(jtrim(c)) == "NULL", F.lit(False))


def to_double(c: Column) -> Column:
    """A cast that gives null instead of an error."""
    return c.try_cast("double")


def num_de(c: Column) -> Column:
    """The German number that a text begins with: points group, a comma starts the decimals."""
    head = F.regexp_extract(c, r"^(-?\d[\d.]*(?:,\d*)?)", 1)
    return to_double(F.replace(F.replace(head, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def num(c: Column) -> Column:
    """The number of a text with a decimal comma or point, else what :func:`num_de` reads."""
    return F.coalesce(to_double(F.replace(c, F.lit(","), F.lit("."))), num_de(c))


def dt(c: Column) -> Column:
    """The timestamp of a text of one of these forms, each with or without a time of day; impossible days give null.

    yyyy/MM/dd, yyyy-MM-dd, yyyy.MM.dd; dd/MM/yy and dd.MM.yy in this century; dd/MM/yyyy and dd.MM.yyyy in which
    one of day and month may have one digit, and dd-MM-yyyy; the same three with the month first, of two digits,
    where the day can't come first; and yyyy-MM-ddTHH:mm:ss.SSSZ. The shape of a text is tested by one pattern
    each, and its fields are put into ISO order for a cast.
    """
    stamp = lambda x: x.try_cast("timestamp")
    turned = lambda shape, order: stamp(F.regexp_replace(c, shape, order))
    day_first = turned(r"^(\d{1,2}).(\d{1,2}).(\d{4})", "$3-$2-$1")
    month_first = F.when(c.rlike(r"^\d{2}.\d{2}."), turned(r"^(\d{2}).(\d{2}).(\d{4})", "$3-$1-$2"))
    return (
        F.when(c.rlike(_YEAR_FIRST), turned(r"^(\d{4}).(\d{2}).(\d{2})", "$1-$2-$3"))
        .when(c.rlike(_YEAR_LAST), F.coalesce(day_first, month_first))
        .when(c.rlike(_SHORT_YEAR), turned(r"^(\d{2}).(\d{2}).(\d{2})", "20$3-$2-$1"))
        .when(c.rlike(_ISO_MILLIS), stamp(c))
    )


def date_of(value: str) -> str | None:
    """The same for one text, on the driver: its ISO form, or None."""
    time = re.search(r" (\d{2}):(\d{2}):(\d{2})\Z", value)
    day, clock = (value[: time.start()], time.groups()) if time else (value, ("00", "00", "00"))
    found = re.fullmatch(r"(\d{1,4})([./-])(\d{1,2})\2(\d{2}|\d{4})", day, re.A)
    if re.fullmatch(_ISO_MILLIS[1:-2], value, re.A):
        tries, clock = [value[:10].split("-")], (value[11:13], value[14:16], value[17:19])
    elif not found:
        return None
    else:
        a, sep, b, y = found.groups()
        two = len(a) == len(b) == 2
        if len(a) == 4:
            tries = [(a, b, y)] if len(b) == len(y) == 2 else []
        elif len(y) == 4:
            tries = [(y, b, a)] + [(y, a, b)] * two if len(a) <= 2 and (two or (sep != "-" and 2 in (len(a), len(b)))) else []
        else:
            tries = [(f"20{y}", b, a)] if two and sep != "-" else []
    for fields in tries:
        try:
            return datetime(*map(int, fields), *map(int, clock)).isoformat(sep=" ")
        except ValueError:
            continue
    return None


def java_double(c: Column) -> Column:
    """A double as text, as the JVM writes it."""
    return c.cast("double").cast("string")


def any_of(conditions: list[Column], seed: bool = False) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(seed))


def all_of(conditions: list[Column], seed: bool = True) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(seed))
