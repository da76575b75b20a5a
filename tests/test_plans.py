import pytest
from pyspark.sql import functions as F

from loomgrid.plans.cleaning import CleaningOptions, clean, column_id
from loomgrid.plans.mapping import Matcher, Ref, harmonize, matchers, range_type
from loomgrid.streaming.clean import clean_stream


def test_options_from_json():
    o = CleaningOptions.from_json({"removeDuplicates": True, "normalizeURLs": True, "extractURLComponents": True, "fillColumns": ["a"], "unknown": 1})
    assert o.remove_duplicates and o.normalize_urls and o.extract_url_components and o.fill_columns == ["a"] and o.any
    assert not CleaningOptions(merge_trim_values=True).any and column_id("f:::c") == "c"


def test_nothing_asked_nothing_done(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    assert clean(df, CleaningOptions()) is df


def test_pipeline_order(spark):
    df = spark.createDataFrame([(1, " a ", "2020/01/02"), (2, " a ", "2020/01/02"), (3, "", ""), (4, "b", "x")], "id int, t string, d string")
    o = CleaningOptions(remove_duplicates=True, remove_empty_rows=True, trim_whitespace=True, standardize_dates=True, extract_date_components=True, pad_values=True, pad_length=4, pad_character="_")
    got = [tuple(r) for r in clean(df, o, "id").select("id", "t", "d", "d_year").orderBy("id").collect()]
    assert got == [(1, "a _", "2020-01-02", "2020"), (4, "b___", "x___", None)]  # padded before it is trimmed


def test_messy_products(spark):
    df = spark.createDataFrame([(1, "  Widget ", "10,5", "007"), (2, "GADGET", "20", "0"), (3, "widget", "30", "12")], "id int, product string, price string, stock string")
    o = CleaningOptions(trim_whitespace=True, standardize_case=True, case_mode="title", standardize_numeric=True, numeric_columns=["price"], numeric_mode="double", remove_leading_zeros=True)
    assert [tuple(r) for r in clean(df, o, "id").orderBy("id").collect()] == [(1, "Widget", "10.5", "7"), (2, "Gadget", "20.0", "0"), (3, "Widget", "30.0", "12")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(" A ",), ("b",)], "v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in"))
    out = clean_stream(stream, CleaningOptions(trim_whitespace=True, standardize_case=True, case_mode="lower"))
    query = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.v for r in spark.table("cleaned").collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="remove_duplicates"):
        clean_stream(stream, CleaningOptions(remove_duplicates=True))


X, Y = "n::f.csv::x", "n::f.csv::y"
EQ = {"==": [{"var": X}, "foo"]}


def test_logic_forms():
    assert matchers(EQ) == [Matcher(Ref("n::f.csv", "x"), "equal", "foo")]
    assert matchers({"===": ["foo", X]}) == matchers(EQ)
    assert matchers({"==": [{"sourceId": "n::f.csv", "column": "x"}, 5]})[0].value == "5"
    assert matchers({"==": [X, 5.0]})[0].value == "5.0"
    assert matchers({"==": [X, True]})[0].value == "true"
    assert [m.value for m in matchers({"or": [EQ, {"==": [Y, "bar"]}]})] == ["foo", "bar"]
    assert [m.value for m in matchers({"and": [EQ, {"==": [Y, "bar"]}]})] == ["foo", "bar"]
    assert matchers({"and": [EQ, {"==": [Y, "bar"]}]}, "strict")[0][0] == "and"
    span = matchers({"and": [{">": [{"to_number": [X]}, 40]}, {"<=": [X, 60]}]})[0]
    assert (span.low, span.high, span.value) == (40, 60, ("integer", ""))
    assert matchers({"and": [{">": [X, 40]}, {"<=": [X, 60]}]}, "strict")[0].value == ("integer", "(]")
    assert matchers({"in": [X, ["a"]]})[0].value == "a" and matchers({"in": [X, ["a", "b"]]}) == []
    assert [m.value for m in matchers({"in": [X, ["a", "b"]]}, "strict")] == ["a", "b"]
    for form in ({"type": [X, "Integer"]}, {"ns:type": [X, "integer"]}, {"isInteger": [X]}, {"is_integer": X}, {"ns:isInteger": [X]}):
        assert matchers(form)[0].value == "integer"
    assert matchers({"isNumber": [X]})[0].value == "double" and matchers({"isDate": [X]})[0].value == "date"
    for form in ({"!=": [X, 1]}, {"!": [X]}, {"<": [X, 1]}, {}, None, {"==": [X]}, {"==": ["x", "y"]}):
        assert matchers(form) == []
    with pytest.raises(ValueError):
        matchers({"!=": [X, 1]}, "strict")
    assert (range_type("2020-01-01", "2020-02-01"), range_type(1, 2.0), range_type(1.5, 2)) == ("date", "integer", "double")


def rule(logic, value):
    return {"logic": logic, "then": {"value": value}}


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_equality_rule(spark):
    df = spark.createDataFrame([("foo", "bar"), ("x", "z")], "x string, y string")
    spec = {"mappings": [{"targetField": "mapped", "inputs": [{"sourceId": "n::f.csv", "column": "x"}], "rules": [rule(EQ, "YES")]}]}
    assert rows_of(harmonize(df, spec, "f.csv")) == [("YES",), ("",)]
    assert harmonize(df, spec, "other.csv").columns == []
    assert harmonize(df, {}, "f.csv").columns == []


def test_range_and_one_hot(spark):
    df = spark.createDataFrame([("25", "88"), ("42", "55"), ("70", "30")], "age string, score string")
    span = {"and": [{">=": ["n::f.csv::age", 40]}, {"<=": ["n::f.csv::age", 60]}]}
    spec = {"mappings": [
        {"mappingType": "one-hot", "inputs": [{"column": "age"}], "outputs": [{"targetField": "age_group", "logic": span, "trueValue": "yes"}]},
        {"targetField": "high_score", "inputs": [{"sourceId": "n::f.csv", "column": "score"}], "rules": [rule({"==": ["n::f.csv::score", "88"]}, "TOP")]},
    ]}
    out = harmonize(df, spec, "f.csv")
    assert out.columns == ["age_group", "high_score"]
    assert sorted(rows_of(out)) == [("0", ""), ("0", "TOP"), ("1", "")]


def test_typed_passthrough(spark):
    df = spark.createDataFrame([("6", "68"), ("8", "62")], ["Barthel Change", "Age"])
    then = {"kind": "source-value", "sourceId": "n::f.csv", "column": "Barthel Change"}
    rules = [{"logic": {"isInteger": ["n::f.csv::Barthel Change"]}, "then": then}, {"logic": {"isInteger": ["n::g.csv::Age"]}, "then": {"kind": "source-value"}}]
    spec = {"mappings": [{"targetField": "Total", "inputs": [{"sourceId": "n::f.csv", "column": "Barthel Change"}], "rules": rules}]}
    assert rows_of(harmonize(df, spec, "f.csv")) == [("6",), ("8",)]


def test_reference_and_is_or_strict_and_is_and(spark):
    df = spark.createDataFrame([("foo", "no"), ("foo", "bar")], "x string, y string")
    spec = {"mappings": [{"targetField": "t", "inputs": [{"sourceId": "n::f.csv", "column": "x"}], "rules": [rule({"and": [EQ, {"==": [Y, "bar"]}]}, "1")]}]}
    assert rows_of(harmonize(df, spec, "f.csv")) == [("1",), ("1",)]
    assert rows_of(harmonize(df, spec, "f.csv", "strict")) == [("",), ("1",)]


def test_text_bounds_are_an_error(spark):
    df = spark.createDataFrame([("1",)], "x string")
    logic = {"and": [{">=": [X, "1"]}, {"<=": [X, "2"]}]}
    with pytest.raises(ValueError):
        harmonize(df, {"mappings": [{"targetField": "t", "inputs": [{"sourceId": "n::f.csv", "column": "x"}], "rules": [rule(logic, "1")]}]}, "f.csv")
    dates = {"and": [{">=": [X, "2020-01-01"]}, {"<=": [X, "31/12/2020"]}]}
    out = harmonize(spark.createDataFrame([("2020-05-05",), ("2021-01-01",)], "x string"), {"mappings": [{"targetField": "t", "inputs": [{"sourceId": "n::f.csv", "column": "x"}], "rules": [rule(dates, "in")]}]}, "f.csv")
    assert rows_of(out.select(F.col("t"))) == [("in",), ("",)]
