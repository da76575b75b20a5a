import time
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgrid import api
from loomgrid.operators import metadata, policy
from loomgrid.sources import sinks, tables
from loomgrid.streaming.jobs import CANCELED, DONE, ERROR, Gone, Jobs, NotReady


def put(path, text):
    path.write_text(text)
    return str(path)


def cells(df):
    return [tuple(r) for r in df.drop(tables.ROW).collect()]


@pytest.mark.parametrize(("name", "text"), [("a.csv", "c1,c2\n 1 ,x\n2, y \n"), ("b.csv", "c1;c2\n1;x\n\n2;y\n"), ("c.csv", "c1\tc2\n1\tx\n2\ty\n"), ("d.tsv", "c1\tc2\n1\tx\n2\ty\n")])
def test_delimited(spark, tmp_path, name, text):
    df = tables.read_table(spark, put(tmp_path / name, text))
    assert df.columns[:2] == ["c1", "c2"] and cells(df) == [("1", "x"), ("2", "y")]


def test_quotes_and_short_records(spark, tmp_path):
    df = tables.read_table(spark, put(tmp_path / "q.csv", 'a,b\n"x, ""y""\nz",1\nshort\n'))
    assert cells(df) == [('x, "y"\nz', "1"), ("short", None)]


def workbook(path, *sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    letter = lambda k: chr(65 + k)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="S{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(len(sheets))) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        shared = []
        for k, rows in enumerate(sheets):
            body = ""
            for i, row in enumerate(rows, 1):
                body += f'<row r="{i}">'
                for j, value in enumerate(row):
                    if isinstance(value, (int, float)):
                        body += f'<c r="{letter(j)}{i}"><v>{value}</v></c>'
                    elif value is not None:
                        body += f'<c r="{letter(j)}{i}" t="s"><v>{len(shared)}</v></c>'
                        shared.append(value)
                body += "</row>"
            book.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet {ns}><dimension ref="A1:B{len(rows)}"/><sheetData>{body}</sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
    return str(path)


def test_workbook(spark, tmp_path):
    path = workbook(tmp_path / "w.xlsx", [["h1", "h2"], ["a", 1.5], [None, None], ["b", 2]], [["h2", "h3"], [3, "x"]])
    df = tables.read_table(spark, path)
    assert df.columns[:3] == ["h1", "h2", "h3"]
    assert sorted(cells(df), key=str) == sorted([("a", "1,5", None), ("b", "2", None), (None, "3", "x")], key=str)
    assert tables.read_xlsx(spark, path, skip_blank=False).count() == 4
    assert [r.h1 for r in tables.read_table(spark, path, {"operator": "AND", "conditions": {"h1": "b"}}).collect()] == ["b"]
    assert tables.estimated_rows(spark, path) == 4


def test_screen(spark, tmp_path):
    with pytest.raises(tables.Refused):
        tables.read_table(spark, put(tmp_path / "x.csv", "a\n<script>\n"))
    with pytest.raises(tables.Refused):
        tables.read_table(spark, put(tmp_path / "x.exe", "a"))
    assert tables.passes_screen(spark, put(tmp_path / "x.tsv", "<script>")) and tables.passes_screen(spark, put(tmp_path / "y.csv", "<SCRIPT>\n"))


def test_huge(spark, tmp_path):
    small, large = put(tmp_path / "s.csv", "a\n" + "1\n" * 10), put(tmp_path / "l.csv", "a\n" + "1\n" * 6000)
    assert (tables.is_huge(spark, small), tables.is_huge(spark, large)) == (False, True)
    assert tables.detect_delimiter(["a;b;c,d"]) == ";" and tables.detect_delimiter(["a,b;c"]) == ";" and tables.detect_delimiter(["abc"]) == ","


def test_write_file(spark, tmp_path):
    df = spark.createDataFrame([("x;y", None), ('q"', "2")], "a string, b string")
    path = str(tmp_path / "out.csv")
    assert sinks.write_file(df, path)
    assert (tmp_path / "out.csv").read_text().splitlines() == ["a;b", '"x;y";', '"q""";2']
    assert not sinks.write_file(df.limit(0), path) and "x;y" in (tmp_path / "out.csv").read_text()
    assert sinks.cleaned_path("d/f.xlsx") == "d/f_cleaned.csv" and sinks.parsed_path("d/f.csv") == "d/parsed_f.csv" and sinks.elements_name("a b.csv") == "a_b_elements.csv"


def test_clean_and_harmonize_files(spark, tmp_path):
    path = put(tmp_path / "t.csv", "a;b;date\n1;foo;2025/07/11\n1;foo;2025/07/11\n;;\n2;bar;11-07-2025\n")
    options = {"removeDuplicates": True, "removeEmptyRows": True, "standardizeDates": True}
    spec = {"mappings": [{"targetField": c, "inputs": [{"sourceId": "n::t.csv", "column": c}], "rules": []} for c in ("a", "b", "date")]}
    from loomgrid.plans.cleaning import CleaningOptions

    (out,) = api.harmonize_files(spark, [path], spec, CleaningOptions.from_json(options))
    lines = open(out).read().splitlines()
    assert lines[0] == "a;b;date" and sorted(lines[1:]) == ["1;foo;2025-07-11", "2;bar;2025-07-11"]
    assert api.harmonize_files(spark, [path], {}) == [out] and open(out).read() == "\n"
    assert api.clean_file(spark, path, options) == path
    assert open(path).read().splitlines() == ["a;b;date", "1;foo;2025-07-11", "2;bar;2025-07-11"]


def test_profile_files(spark, tmp_path):
    path = put(tmp_path / "p.csv", "n,c\n1.5,x\n2.5,y\n")
    good, bad = api.profile_files(spark, [path, str(tmp_path / "p.exe")])
    assert good["continuous"].first().mean == 2.0 and "aren't allowed" in bad
    assert api.profile_file(spark, path, {"operator": "AND", "conditions": {"c": "none"}}) == "No matching records"


TURTLE = """@prefix dcat: <http://www.w3.org/ns/dcat#> . @prefix dct: <http://purl.org/dc/terms/> .
<http://x/d1> a dcat:Dataset ; dct:title "First \\"one\\""@en ; dcat:keyword "a", "b" ; dct:publisher [ dct:title "P" ; dct:type [ dct:title "deep" ] ] ;
  dcat:distribution <http://x/dist1> ; <http://other/extra> 5 . # comment
<http://x/dist1> a dcat:Distribution ; dcat:mediaType "text/csv" .
<http://x/cat> a dcat:Catalog .
"""


def test_metadata(spark, tmp_path):
    put(tmp_path / "m.ttl", TURTLE)
    t = metadata.read_triples(spark, str(tmp_path / "m.ttl")).cache()
    row = metadata.datasets(t).first()
    assert (row.title, row.keywords, row.distributions) == ('First "one"', ["a", "b"], ["http://x/dist1"])
    starts = metadata.subjects_of_type(t)
    assert {r.o for r in metadata.closure(t, starts).where("level > 0 and kind = 'literal'").collect()} == {"P", "deep"}
    assert metadata.linked(t, f"{metadata.DCAT}distribution", {"media": f"{metadata.DCAT}mediaType"}).first().media == "text/csv"
    assert metadata.parents(t).first().parent == "http://x/cat"
    assert metadata.additional_properties(t.where("s = 'http://x/d1'"), ["title", "keyword", "publisher", "distribution"]).first().properties == {"http://other/extra": ["5"]}
    done = metadata.completed(metadata.datasets(t), "theme", "me").first()
    assert (done.version, done.themes) == ("1.0", ["theme"])


def test_catalog(spark):
    files = spark.createDataFrame([("Stroke Data.csv", "2020-01-02"), ("parsed_stroke data.csv", "2020-01-05"), ("B.xlsx", "2020-01-01")], "name string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    groups = {r.dataset: r for r in metadata.dataset_groups(files).collect()}
    assert groups["stroke data"].files == ["Stroke Data.csv", "parsed_stroke data.csv"] and groups["stroke data"].slug == "stroke-data" and groups["b"].modified.day == 1
    triples = [t for r in metadata.catalog_turtle(metadata.dataset_groups(files), "http://h").collect() for t in metadata.triples_of(r.value)]
    assert sum(t[2] == f"{metadata.DCAT}Dataset" for t in triples) == 2 and ("http://h/dataset/b", f"{metadata.DCT}title", "B", "literal") in triples


def test_policy(spark, tmp_path):
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "A x.csv", "1")
    put(tmp_path / "d" / "parsed_A x.csv", "2")
    put(tmp_path / "d" / "other.csv", "3")
    files = policy.fingerprints(spark, str(tmp_path / "d")).cache()
    none = spark.createDataFrame([], policy.MANIFEST)
    shared = policy.share(none, files, "a-x")
    assert {r.name for r in policy.downloadable(files, shared).collect()} == {"A x.csv", "parsed_A x.csv"}
    assert policy.unshare(shared, "a-x").count() == 0 and policy.share(shared, files, "a-x").count() == 2
    selectors = spark.createDataFrame([("other.csv",)], "selector string")
    seeded, known = policy.seed(shared, files, selectors, spark.createDataFrame([], "selector string"))
    assert seeded.count() == 3 and policy.seed(seeded, files, selectors, known)[0].count() == 3
    assert [r.name for r in tables.list_files(spark, str(tmp_path / "d")).collect()] == ["A x.csv", "other.csv", "parsed_A x.csv"]


def test_jobs(spark):
    jobs = Jobs(spark)
    good, bad = jobs.start(lambda report: (report(50, "half"), 7)[1]), jobs.start(lambda report: 1 / 0)
    slow = jobs.start(lambda report: spark.range(1).select(F.udf(lambda x: time.sleep(60))("id")).collect())
    time.sleep(3)
    assert jobs.status(good).state == DONE and jobs.result(good) == 7 and jobs.status(bad).state == ERROR
    with pytest.raises(Gone):
        jobs.result(good)
    with pytest.raises(NotReady):
        jobs.result(bad)
    with pytest.raises(NotReady):
        jobs.result(slow)
    assert jobs.cancel(slow) and jobs.status(slow).state == CANCELED and jobs.cancel("unknown")
    with pytest.raises(Gone):
        jobs.result(slow)


def test_other_syntaxes():
    xml = f'<rdf:RDF xmlns:rdf="{metadata.RDF}" xmlns:dct="{metadata.DCT}" xmlns:dcat="{metadata.DCAT}"><dcat:Dataset rdf:about="http://x/d"><dct:title>T</dct:title><dcat:distribution rdf:resource="http://x/s"/><dct:publisher><rdf:Description><dct:title>P</dct:title></rdf:Description></dct:publisher></dcat:Dataset></rdf:RDF>'
    found = metadata.triples_of_file("m.rdf", xml)
    assert ("http://x/d", metadata.TYPE, f"{metadata.DCAT}Dataset", "uri") in found and ("http://x/d", f"{metadata.DCT}title", "T", "literal") in found
    assert any(t[1] == f"{metadata.DCT}publisher" and t[3] == "blank" for t in found)
    json = '{"@context": {"dcat": "http://www.w3.org/ns/dcat#", "title": "http://purl.org/dc/terms/title", "part": {"@id": "dcat:distribution", "@type": "@id"}}, "@graph": [{"@id": "http://x/d", "@type": "dcat:Dataset", "title": ["a", {"@value": true}], "part": "http://x/s"}]}'
    found = metadata.triples_of_file("unknown.txt", json)
    assert {t[2] for t in found if t[0] == "http://x/d"} == {f"{metadata.DCAT}Dataset", "a", "true", "http://x/s"}
    assert metadata.triples_of_file("n.nt", '<http://a> <http://b> "c"@en .\n_:x <http://b> <http://d> .')[1] == ("_:x", "http://b", "http://d", "uri")
    with pytest.raises(ValueError):
        metadata.triples_of_file("m.ttl", "<<<")


def test_forced_features(spark, tmp_path):
    path = put(tmp_path / "r.csv", "d,t,u\n" + "".join(f"2020-01-{k + 1:02},x,u{k}\n" for k in range(12)))
    assert "dates" in api.reprofile_file(spark, path, "d", "continuous") and "categories" in api.reprofile_file(spark, path, "t", "categorical")
    assert api.reprofile_file(spark, path, "u", "categorical") == "This field cannot be converted to categorical."
    assert api.reprofile_file(spark, path, "none", "categorical") == "No feature none"


def test_large_csv_is_read_in_pieces(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("a,b\n" + "".join(f"{k},x{k}\n" for k in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = tables.read_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 50_000
        assert [r.a for r in df.orderBy(tables.ROW).limit(3).collect()] == ["0", "1", "2"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text('a,b\n1,"two\nlines"\n')
    assert [(r.a, r.b) for r in tables.read_csv(spark, str(path)).collect()] == [("1", "two\nlines")]


def test_a_written_file_replaces_the_old_one(spark, tmp_path):
    path = tmp_path / "out.csv"
    path.write_text("old")
    assert sinks.write_file(spark.createDataFrame([("1",)], "a string"), str(path))
    assert path.read_text() == "a\n1\n" and [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []


def test_displayed_numbers():
    from loomgrid.sources.display import BUILT_IN, GENERAL, display, is_date_format

    wanted = [
        (1.5, GENERAL, "1,5"), (1 / 3, GENERAL, "0,3333333333"), (1e12, GENERAL, "1E12"), (45322, "m/d/yy", "1/31/24"), (45322.5, "dd.mm.yyyy hh:mm", "31.01.2024 12:00"), (45322.75, "[$-407]d. mmmm yyyy;@", "31. Januar 2024"),
        (45322.6, "h:mm AM/PM", "2:24 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (0.1234, "0.00%", "12,34%"), (1234567.891, "#,##0.00", "1.234.567,89"), (-1234.5, "#,##0.00_);(#,##0.00)", "(1.234,50)"),
        (1.25, '0.0" kg"', "1,3 kg"), (0.00012345, "0.00E+00", "1,23E-04"), (3, "000", "003"), (-0.001, "0.00", "0,00"), (59, "d.m.yyyy", "28.2.1900"), (0.5, "# ?/?", "0,5"), (-1, "m/d/yy", "-1"),
    ]
    assert [display(v, c) for v, c, _ in wanted] == [t for _, _, t in wanted]
    assert display(0, "yyyy-mm-dd", since_1904=True) == "1904-01-01"
    assert {k for k, c in BUILT_IN.items() if is_date_format(c)} == {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def test_nested_properties(spark, tmp_path):
    import json

    put(tmp_path / "m.ttl", TURTLE + "<http://x/d1> <http://other/near> [ dct:title 'a', 'b' ; dct:relation <http://x/dist1> ; dct:source <http://x/d1> ] .")
    found = metadata.nested_properties(metadata.read_triples(spark, str(tmp_path / "m.ttl")), ["title", "keyword", "distribution"]).collect()
    said = json.loads(found[0].properties)
    assert len(found) == 1 and said["http://other/extra"] == "5" and said["dct:publisher"] == {"dct:title": "P", "dct:type": {"dct:title": "deep"}}
    near = said["http://other/near"]
    assert near["dct:title"] == ["a", "b"] and near["dct:relation"] == {"uri": "http://x/dist1", "rdf:type": f"{metadata.DCAT}Distribution", "dcat:mediaType": "text/csv"}
    assert near["dct:source"]["uri"] == "http://x/d1" and "_:" in str(near["dct:source"]["http://other/near"])  # seen before: only its name
    said = {"a": [("p", "b", "blank")], "b": [("p", "c", "blank")], "c": [("p", "d", "blank")], "d": [("p", "e", "literal")]}
    assert metadata.expanded("a", "blank", said) == {"p": {"p": {"p": "d"}}}


def test_files_that_are_missing_are_left_out(spark, tmp_path):
    path = put(tmp_path / "t.csv", "a\n1\n")
    spec = {"mappings": [{"targetField": "a", "inputs": [{"sourceId": "n::t.csv", "column": "a"}], "rules": []}]}
    with pytest.warns(UserWarning, match="left out"):
        assert api.harmonize_files(spark, [str(tmp_path / "none.csv"), path], spec) == [str(tmp_path / "parsed_t.csv")]


def test_written_elements_and_listed_times(spark, tmp_path):
    assert sinks.write_elements(str(tmp_path), "a b.XLSX", "x;y\n", spark.range(1)) == str(tmp_path / "a_b_elements.csv")
    (row,) = tables.list_files(spark, str(tmp_path)).collect()
    assert (row.name, row.size) == ("a_b_elements.csv", 4) and abs((row.created - row.modified).total_seconds()) < 60
