import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import numeric, text
from loomgrid.functions.scalars import date_of, missing, num, num_de
from loomgrid.functions.scalars import dt as parsed


def one(table, expression):
    return [r[0] for r in table.orderBy("id").select(expression.alias("x")).collect()]


def test_numbers(cells):
    given = ["123.45", "-123.45", "123,45", "1.234,56", "1.234", "1.234.567", "1,234,567", "12abc", "2020-01-02", "1e10", "abc", "", None]
    assert one(cells(*given), num(F.col("v"))) == [123.45, -123.45, 123.45, 1234.56, 1.234, 1234567.0, 1.234, 12.0, 2020.0, 1e10, None, None, None]
    assert one(cells("1.5", "+3", " 3", "1e5", "-2,5"), num_de(F.col("v"))) == [15.0, None, None, 1.0, -2.5]


DATES = {
    "2023-12-25": "2023-12-25", "25/12/2023": "2023-12-25", "12/25/2023": "2023-12-25", "2023/12/25": "2023-12-25", "25.12.2023": "2023-12-25", "12.25.2023": "2023-12-25",
    "25-12-2023": "2023-12-25", "25/12/2023 14:30:45": "2023-12-25", "2023-12-25T14:30:45.123Z": "2023-12-25", "02/01/20": "2020-01-02", "03.02.21 15:30:00": "2021-02-03",
    "2022/03/04 08:05:06": "2022-03-04", "03/04/99": "2099-04-03", "1/02/2020": "2020-02-01", "not a date": None, "": None, "32/13/2023": None, "1/2/2020": None, "30/02/2020": None, "3.4": None,
}


def test_dates(cells):
    table = cells(*DATES)
    found = one(table, F.date_format(parsed(F.col("v")), "yyyy-MM-dd"))
    assert found == list(DATES.values())
    assert [d and d[:10] for d in map(date_of, DATES)] == found


def test_random_dates_agree_on_driver_and_executors(cells):
    rng = random.Random(1)
    given = [f"{rng.choice(['', '0'])}{rng.randint(1, 40)}{s}{rng.randint(1, 14)}{s}{rng.choice([rng.randint(0, 99), rng.randint(1900, 2100)])}{rng.choice(['', ' 10:11:12', ' 25:00:00'])}" for s in "/.-" for _ in range(80)]
    given += [f"{rng.randint(1900, 2100)}{s}{rng.randint(1, 13):02}{s}{rng.randint(1, 32):02}" for s in "/.-" for _ in range(40)]
    assert one(cells(*given), F.date_format(parsed(F.col("v")), "yyyy-MM-dd HH:mm:ss")) == [date_of(v) for v in given]


def test_missing(cells):
    assert one(cells(None, "", " \t", "null", " NULL ", "x"), missing(F.col("v"))) == [True] * 5 + [False]


CASES = [
    (text.trim, "  hello  ", "hello"), (text.trim, "world\t", "world"), (text.squeeze, "Hello    World  \n  Test", "Hello World Test"),
    (text.join_lines, "hello\nworld\r\ntest", "hello world test"), (lambda c: text.case(c, "upper"), "Hello World", "HELLO WORLD"),
    (lambda c: text.case(c, "title"), "hello world test", "Hello World Test"), (lambda c: text.case(c, "sentence"), "HELLO WORLD TEST", "Hello world test"),
    (lambda c: text.case(c, "other"), "aB", "aB"), (text.drop_special, "Hello@World#123!", "HelloWorld123"), (text.drop_punctuation, "Hello, World! How are you?", "Hello World How are you"),
    (text.drop_unprintable, "Hello\x00World\x01Test", "HelloWorldTest"), (text.fix_encoding, "CafÃ©", "Café"), (text.fix_encoding, "plain", "plain"),
    (text.drop_leading_zeros, "00123", "123"), (text.drop_leading_zeros, "hello", "hello"), (text.drop_leading_zeros, "0", "0"), (text.drop_leading_zeros, "000", ""),
    (text.drop_leading_zeros, "007abc", "7abc"), (text.drop_leading_zeros, "0.5", "0.5"), (lambda c: text.strip_prefix(c, "PREFIX_"), "PREFIX_123", "123"),
    (lambda c: text.strip_suffix(c, "_DRAFT"), "document_DRAFT", "document"), (lambda c: text.pad(c, 5, "0", "left"), "123", "00123"), (lambda c: text.pad(c, 5, "X"), "AB", "ABXXX"),
    (lambda c: text.pad(c, 2, "X"), "ABCD", "ABCD"), (text.email_domain, "write user@example.com now", "example.com"), (text.valid_email, "valid@email.com", "valid@email.com"),
    (text.valid_email, "bad@", ""), (text.valid_email, "invalid-email", "invalid-email"), (text.normal_url, "HTTPS://Example.Com/Path/", "HTTPS://Example.Com/Path/"),
    (text.normal_url, "https://Example.Com/Path/", "https://example.com/path"), (lambda c: text.phone(c, "international"), "1234567890", "+1 (123) 456-7890"),
    (text.phone, "5551234567", "(555) 123-4567"), (lambda c: text.phone(c, "e164"), "0015551234567", "+15551234567"), (text.phone, "12", "12"),
    (lambda c: text.replace_values(c, {"active": "ACTIVE"}), "active", "ACTIVE"), (lambda c: text.replace_values(c, {"active": "ACTIVE"}), "inactive", "inactive"),
    (lambda c: text.unicode_form(c, "NFC"), "é", "é"), (lambda c: text.unicode_form(c, "NFKD"), "ﬁ", "fi"),
    (lambda c: numeric.standard_date(c, "DD/MM/YYYY"), "2020-01-02", "02/01/2020"), (lambda c: numeric.standard_date(c, "yyyy/MM/dd"), "02-01-2020", "2020/01/02"), (numeric.standard_date, "notadate", "notadate"),
    (lambda c: numeric.round_decimals(c, 2), "10.12345", "10.12"), (lambda c: numeric.round_decimals(c, 0), "10.678", "11.0"), (lambda c: numeric.round_decimals(c, 0), "-2.5", "-2.0"),
    (lambda c: numeric.round_decimals(c, 2), "text", "text"), (lambda c: numeric.convert(c, "integer"), "25", "25"), (lambda c: numeric.convert(c, "float"), "19.99", "19.99"), (lambda c: numeric.convert(c, "boolean"), "TRUE", "true"),
    (lambda c: numeric.standard_number(c, "int_round"), "2,5", "3"), (lambda c: numeric.standard_number(c, "int_trunc"), "-2.7", "-2"), (lambda c: numeric.standard_number(c, "double"), "7", "7.0"),
]


def test_scalar_functions(cells):
    table = cells(*[v for _, v, _ in CASES])
    picked = table.select("id", F.when(F.lit(True), F.col("v")).alias("v"))
    for k, (function, value, wanted) in enumerate(CASES):
        found = picked.where(F.col("id") == k).select(function(F.col("v")).alias("x")).first()[0]
        assert found == wanted, (k, value, found, wanted)


def test_nulls_stay_null(cells):
    row = cells(None).select(*[f(F.col("v")).alias(f"x{k}") for k, (f, _, _) in enumerate(CASES)]).first()
    assert all(v is None for v in row)


def test_url_parts(cells):
    parts = text.url_parts(F.col("v"))
    found = cells("https://www.example.com/path/page?query=1", "ftp://x", "http://a").select(*[v.alias(k) for k, v in parts.items()]).collect()
    assert [tuple(r) for r in found] == [("https://", "www.example.com", "/path/page", "?query=1"), (None,) * 4, ("http://", "a", None, None)]


def test_bins(cells):
    labels = ["child", "young_adult", "adult", "senior"]
    assert one(cells("5", "25", "45", "75", "130", "-1", "x", None), numeric.bin_of(F.col("v"), [0, 18, 35, 65, 120], labels)) == ["child", "young_adult", "adult", "senior", "bin_4", "unknown", None, None]


def test_date_parts(cells):
    row = cells("2023-05-15").select(*[v.alias(k) for k, v in numeric.date_parts(F.col("v")).items()]).first()
    assert (row.year, row.month, row.day) == ("2023", "5", "15")
    assert dt.date(2023, 5, 15).isoformat() == "2023-05-15"


def test_session_settings():
    pytest.importorskip("pyspark")
    from loomgrid.session import session

    assert callable(session)
