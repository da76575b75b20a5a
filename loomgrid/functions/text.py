"""Scalar functions on text cells: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions.scalars import EMAIL, URL, jtrim


def trim(c: Column) -> Column:
    return jtrim(c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return jtrim(F.regexp_replace(c, r"\s+", " "))


def join_lines(c: Column) -> Column:
    """Runs of line breaks as one space, trimmed."""
    return jtrim(F.regexp_replace(c, r"[\r\n]+", " "))


def case(c: Column, mode: str) -> Column:
    """upper, lower, title or sentence; any other mode leaves the text as it is."""
    sentence = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
    return {"upper": F.upper(c), "lower": F.lower(c), "title": F.initcap(squeeze(c)), "sentence": sentence}.get((mode or "").lower(), c)


def drop_special(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s.,_-]", "")


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Punct}", "")


def drop_unprintable(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{C}", "")


def replace_values(c: Column, values: dict[str, str]) -> Column:
    """Whole values replaced by a literal map."""
    if not values:
        return c
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def pad(c: Column, size: int, char: str = " ", direction: str = "right") -> Column:
    """Filled up to ``size`` on the left, or on the right for any other direction; never cut."""
    own = (char or " ")[0]
    filled = F.lpad(c, size, own) if (direction or "").lower() == "left" else F.rpad(c, size, own)
    return F.when(F.length(c) < size, filled).otherwise(c)


def drop_leading_zeros(c: Column) -> Column:
    return F.when(c.rlike(r"^0+[0-9].*\z"), F.regexp_replace(c, r"^0+", "")).otherwise(c)


def email_domain(c: Column) -> Column:
    """The domain of the first e-mail address in the text, else null."""
    return F.when(c.rlike(EMAIL), F.regexp_extract(c, EMAIL, 2))


def valid_email(c: Column) -> Column:
    """Empty if the text has an @ but isn't an e-mail address as a whole."""
    return F.when(F.contains(c, F.lit("@")) & ~c.rlike(rf"^{EMAIL}\z"), F.lit("")).otherwise(c)


def url_parts(c: Column) -> dict[str, Column]:
    """protocol (with ://), domain (with port), path and query (with ?) of an address, each null where there's none."""
    whole = F.startswith(c, F.lit("http")) & c.rlike(URL)
    part = lambda k: F.when(whole, F.regexp_extract(c, URL, k))
    return {"protocol": part(1), "domain": part(2), "path": F.nullif(part(3), F.lit("")), "query": F.nullif(part(4), F.lit(""))}


def normal_url(c: Column) -> Column:
    """Lower case without one final slash, for texts that start with http:// or https://."""
    web = F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))
    return F.when(web, F.regexp_replace(F.lower(c), r"/\z", "")).otherwise(c)


def phone(c: Column, style: str = "national", code: str = "+1") -> Column:
    """The last ten digits of a text that has ten or more, as a phone number."""
    digits = F.regexp_replace(c, r"\D", "")
    last = F.right(digits, F.lit(10))
    national = F.concat(F.lit("("), F.substring(last, 1, 3), F.lit(") "), F.substring(last, 4, 3), F.lit("-"), F.substring(last, 7, 4))
    shaped = {"international": F.concat(F.lit(f"{code} "), national), "e164": F.concat(F.lit(code), last)}.get((style or "national").lower(), national)
    return F.when(F.length(digits) >= 10, shaped).otherwise(c)


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """NFC (default), NFD, NFKC or NFKD; ASCII cells don't reach Python."""
    wanted = form.upper() if form and form.upper() in ("NFD", "NFKC", "NFKD") else "NFC"

    @F.pandas_udf("string")
    def run(cells):  # noqa: ANN001, ANN202
        import unicodedata

        return cells.map(lambda v: v if v is None else unicodedata.normalize(wanted, v))

    return F.when(c.rlike(r"[^\x00-\x7F]"), run(c)).otherwise(c)


#: What a text that was decoded in the wrong way shows.
MISREAD = ("Ã", "Â", "â€", "ï¿½")


def _cp1252(text: str) -> bytes:
    """Windows-1252 as the JVM encodes it: what it doesn't have becomes a question mark."""
    return b"".join(ch.encode("cp1252", "replace") for ch in text)


def repaired(value: str) -> str:
    """The best of a text and of its bytes read as UTF-8: most letters, with five off for each sign of a wrong decoding."""

    def score(s: str) -> int:
        return sum(map(str.isalpha, s)) - 5 * sum(s.count(x) for x in MISREAD)

    def sane(s: str) -> bool:
        return not any((ord(ch) < 32 and ch not in "\n\r\t") or 0x7F <= ord(ch) <= 0x9F for ch in s)

    best, most = value, score(value)
    for raw in (_cp1252(value), value.encode("latin-1", "replace")):
        other = raw.decode("utf-8", "replace")
        if score(other) > most and sane(other):
            best, most = other, score(other)
    return best


def fix_encoding(c: Column) -> Column:
    """Repairs texts that show signs of a wrong decoding; others don't reach Python."""

    @F.pandas_udf("string")
    def run(cells):  # noqa: ANN001, ANN202
        return cells.map(lambda v: v if v is None else repaired(v))

    return F.when(c.rlike("|".join(MISREAD)), run(c)).otherwise(c)
