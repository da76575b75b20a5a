"""How a workbook shows a number: the formats of its style table, with German signs and names."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Context, Decimal

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
GENERAL = "General"
#: The formats that the file format numbers without listing them (ECMA-376, 18.8.30).
BUILT_IN = {
    0: GENERAL, 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
_SHORT_MONTHS = "Jan. Feb. März Apr. Mai Juni Juli Aug. Sept. Okt. Nov. Dez.".split()
_DAYS = "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split()
_PIECE = re.compile(r'"(?P<quoted>[^"]*)"|\\(?P<escaped>.)|_.|\*.|(?P<elapsed>\[(?:h+|m+|s+)\])|\[[^\]]*\]|(?P<noon>AM/PM|A/P)|(?P<fraction>\.0+)|(?P<run>y+|m+|d+|h+|s+)|(?P<other>.)', re.I | re.S)
_QUOTED = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[[^\]]*\]')


def number_formats(styles: bytes | None) -> list[str]:
    """The format of each cell style of a workbook, by the style's number."""
    if not styles:
        return []
    root = ET.fromstring(styles)
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.findall("m:numFmts/m:numFmt", _NS)}
    return [own.get(k, BUILT_IN.get(k, GENERAL)) for k in (int(x.get("numFmtId") or 0) for x in root.findall("m:cellXfs/m:xf", _NS))]


def is_date_format(code: str) -> bool:
    """Whether a format names parts of a date or a time outside its quoted text."""
    if re.search(r"\[(h+|m+|s+)\]", code, re.I):
        return True
    bare = re.sub(r"general|e[+-]", "", _QUOTED.sub("", code.split(";")[0]), flags=re.I)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and not re.search(r"[#?0]", re.sub(r"s\.0+", "s", bare, flags=re.I))


def moment(serial: float, since_1904: bool = False) -> datetime:
    """The time of a serial number, to the millisecond; the first calendar counts a 29 February 1900 that never was."""
    base = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if serial < 61 else datetime(1899, 12, 30)
    return base + timedelta(milliseconds=int(serial * 86_400_000 + 0.5))


def _date_text(value: float, code: str, since_1904: bool) -> str:
    when = moment(value, since_1904)
    pieces = [m for m in _PIECE.finditer(code.split(";")[0])]
    noon, out, last = any(m["noon"] for m in pieces), [], ""
    for k, m in enumerate(pieces):
        run = (m["run"] or "").lower()
        if m["quoted"] is not None or m["escaped"] or m["other"]:
            out.append(m["quoted"] if m["quoted"] is not None else m["escaped"] or m["other"])
        elif m["elapsed"]:
            last = m["elapsed"][1].lower()
            total = int(value * {"h": 24, "m": 1440, "s": 86400}[last] + 1e-9)
            out.append(str(total).zfill(len(m["elapsed"]) - 2))
        elif m["noon"]:
            out.append("AM" if when.hour < 12 else "PM")
        elif m["fraction"]:
            digits = len(m["fraction"]) - 1
            out.append("," + f"{when.microsecond:06d}"[:digits].ljust(digits, "0"))
        elif run:
            after = next((x["run"] or x["elapsed"] or "" for x in pieces[k + 1 :] if x["run"] or x["elapsed"]), "").lower()
            minutes = run[0] == "m" and len(run) < 3 and (last == "h" or after.startswith("s"))
            size = len(run)
            if run[0] == "y":
                out.append(f"{when.year:04d}" if size > 2 else f"{when.year % 100:02d}")
            elif minutes:
                out.append(str(when.minute).zfill(size))
            elif run[0] == "m":
                out.append(str(when.month).zfill(size) if size < 3 else _SHORT_MONTHS[when.month - 1] if size == 3 else _MONTHS[when.month - 1] if size == 4 else _MONTHS[when.month - 1][0])
            elif run[0] == "d":
                day = _DAYS[when.weekday()]
                out.append(str(when.day).zfill(size) if size < 3 else f"{day[:2]}." if size == 3 else day)
            elif run[0] == "h":
                out.append(str(((when.hour - 1) % 12 + 1) if noon else when.hour).zfill(size))
            else:
                out.append(str(when.second).zfill(size))
            last = run[0]
    return "".join(out)


def general(value: float) -> str:
    """Ten significant digits, an exponent from 10^11 on and below 10^-10; a decimal comma."""
    size = abs(value)
    if size >= 1e11 or 0 < size <= 1e-10:
        mantissa, exponent = f"{Decimal(repr(value)).normalize(Context(prec=6, rounding=ROUND_HALF_UP)):E}".split("E")
        return f"{mantissa.replace('.', ',')}E{int(exponent)}"
    if value == int(value) or size >= 1e10:
        return str(int(Decimal(repr(value)).quantize(Decimal(1), ROUND_HALF_UP)))
    rounded = Decimal(repr(value)).normalize(Context(prec=10, rounding=ROUND_HALF_UP))
    text = f"{rounded:.10f}".rstrip("0").rstrip(".").replace(".", ",")
    return "0" if text in ("-0", "") else text


def _number_text(value: float, section: str) -> str | None:
    """A number in one section of a format; None for one with digits in several places, such as fractions."""
    literal = lambda s: _QUOTED.sub(lambda m: m[1] or m[2] or "", s)
    found = re.search(r"[#0,]*[#0](?:\.[#0]*)?(?:E[+-][0#]+)?|\.[#0]+", section)
    if not found or re.search(r"[#0?]", _QUOTED.sub("", section[: found.start()] + section[found.end() :])):
        return None
    pattern = found.group()
    percent = "%" in _QUOTED.sub("", section)
    exact = Decimal(repr(value)) * (100 if percent else 1)
    if "E" in pattern:
        body, power = pattern.split("E")
        places = len(body.partition(".")[2])
        mantissa, exponent = f"{exact:.{places}E}".split("E")
        return literal(section[: found.start()]) + mantissa.replace(".", ",") + "E" + ("-" if exponent[0] == "-" else "") + str(abs(int(exponent))).zfill(len(power) - 1) + literal(section[found.end() :])
    whole, _, part = pattern.partition(".")
    fixed, most = len(part.rstrip("#")), len(part)
    text = str(exact.quantize(Decimal(1).scaleb(-most), ROUND_HALF_UP, Context(prec=400)))
    digits, _, rest = text.partition(".")
    while len(rest) > fixed and rest.endswith("0"):
        rest = rest[:-1]
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    digits = digits.lstrip("0").zfill(whole.count("0"))
    if "," in whole.rstrip(","):
        digits = f"{int(digits):,}".replace(",", ".") if digits else digits
    if not (digits.strip("0.") or rest.strip("0")):
        sign = ""
    return literal(section[: found.start()]) + sign + digits + ("," + rest if rest else "") + literal(section[found.end() :])


def display(value: float, code: str = GENERAL, since_1904: bool = False) -> str:
    """A number as a workbook shows it in a format; formats that aren't known here show it in the general one."""
    sections = code.split(";")
    if code.lower() == "general" or code == "@":
        return general(value)
    if is_date_format(code):
        return _date_text(value, code, since_1904) if 0 <= value < 2_958_466 else general(value)
    if len(sections) > 1 and value < 0:
        text = _number_text(-value, sections[1])
    else:
        text = _number_text(value, sections[2] if len(sections) > 2 and value == 0 else sections[0])
    return general(value) if text is None else text
