"""Registered queries over files, jobs, mappings' odd rules, metadata and sharing: what they read is first written from the tables."""

from __future__ import annotations

import io
import posixpath
import time
import warnings
import zipfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import api
from loomgrid.operators import fuzzy, metadata, pairwise, policy
from loomgrid.operators import profile as prof
from loomgrid.operators.ranks import scratch, scratch_folder
from loomgrid.plans.mapping import harmonize
from loomgrid.plans.queries import ORACLES, QUERIES, _between, _c, _order_categories, _read, _ref, _rounded, _standard, query
from loomgrid.sources import sinks, tables
from loomgrid.streaming.jobs import Gone, Jobs, NotReady

__all__ = ["ORACLES", "QUERIES"]


def _put(spark: SparkSession, path: str, content: bytes) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(content))
    out.close()
    return path


def _workbook(sheets: list[list[list]]) -> bytes:
    """A workbook of texts and of (number, style); style 1 is a day, 2 an amount, 3 a share."""
    main, kin = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v: f'<c s="{v[1]}"><v>{v[0]}</v></c>' if isinstance(v, tuple) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kin}"><sheets>' + "".join(f'<sheet name="s{k}" r:id="r{k}"/>' for k in range(len(sheets))) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="4"/><xf numFmtId="9"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheets):
            body = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows)
            book.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:D{len(rows)}"/><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _nations_book(spark: SparkSession, sf_dir: str) -> str:
    """The nations, a fixed table of 25 rows, as two sheets of a workbook with an empty row in each."""
    nations = [tuple(r) for r in _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").collect()]
    head = ["name", "day", "amount", "share"]
    sheets = [[head, *[[n, (45292 + k, 1), (1000.5 * k, 2), (k / 100, 3)] for k, n, r in nations if (r < 2) == first], ["", "", "", ""]] for first in (True, False)]
    return _put(spark, f"{scratch_folder(spark)}/nations.xlsx", _workbook(sheets))


_BOOK = """SELECT n_name AS name, strftime(DATE '2024-01-01' + n_nationkey::INTEGER, '%d.%m.%Y') AS day, replace(replace(replace(format('{:,.2f}', 1000.5 * n_nationkey), ',', '_'), '.', ','), '_', '.') AS amount, n_nationkey || '%' AS share FROM nation"""


@query(_BOOK)
def q73_workbook_formats(spark, sf_dir):  # noqa: ANN001, ANN201
    return tables.read_table(spark, _nations_book(spark, sf_dir)).drop(tables.ROW)


@query(f"SELECT * FROM ({_BOOK}) WHERE name IN (SELECT n_name FROM nation WHERE n_name < 'NATION_15' OR n_name = 'NATION_7')")
def q74_filtered_workbook(spark, sf_dir):  # noqa: ANN001, ANN201
    wanted = [r[0] for r in _read(spark, sf_dir, "nation").where("n_name < 'NATION_15' or n_name = 'NATION_7'").select("n_name").collect()]  # of 25 rows
    return tables.read_table(spark, _nations_book(spark, sf_dir), {"operator": "AND", "conditions": {"name": wanted}}).drop(tables.ROW)


@query("SELECT 'workbook' AS file, count(*) + 2 AS n, false AS huge FROM nation UNION ALL SELECT 'orders', count(*), count(*) >= 5000 FROM orders UNION ALL SELECT 'regions', count(*), false FROM region")
def q75_estimated_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    folder = scratch_folder(spark)
    paths = {"workbook": _nations_book(spark, sf_dir)}
    for name, table, key in (("orders", "orders", "o_orderkey"), ("regions", "region", "r_regionkey")):
        paths[name] = f"{folder}/{name}.csv"
        sinks.write_file(_read(spark, sf_dir, table, key), paths[name])
    return spark.createDataFrame([(k, tables.estimated_rows(spark, p), tables.is_huge(spark, p)) for k, p in paths.items()], "file string, n bigint, huge boolean")


_QUOTED = "SELECT c_custkey::VARCHAR AS key, '\"' || c_name || '\"; ' || c_mktsegment || ', \t.' AS cell FROM customer"


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit('"'), "c_name", F.lit('"; '), "c_mktsegment", F.lit(", \t.")).alias("cell"))


@query(f"SELECT kind, q.* FROM ({_QUOTED}) q, (VALUES ('csv'), ('tsv')) k(kind)")
def q76_delimited_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    folder, out = scratch_folder(spark), None
    for kind, sep in (("csv", ";"), ("tsv", "\t")):
        path = f"{folder}/customers.{kind}"
        sinks.write_file(_quoted(spark, sf_dir), path, sep)
        sinks.write_file(_quoted(spark, sf_dir).limit(0), path, sep)  # without rows the old file stays
        read = tables.read_csv(spark, path, sep).select(F.lit(kind).alias("kind"), "key", "cell")
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT sep, r_regionkey::VARCHAR AS a, r_name AS b FROM region, (VALUES ('comma'), ('semicolon'), ('tab')) s(sep)")
def q77_detected_delimiters(spark, sf_dir):  # noqa: ANN001, ANN201
    folder, out = scratch_folder(spark), None
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t")):
        path = f"{folder}/{name}.csv"
        sinks.write_file(_read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("a"), F.concat(F.lit(" "), "r_name", F.lit("  ")).alias("b")), path, sep)
        read = tables.read_table(spark, path).select(F.lit(name).alias("sep"), "a", "b")
        out = read if out is None else out.unionByName(read)
    return out


def _region_files(spark: SparkSession, sf_dir: str) -> str:
    """A dictionary of elements for each of the five regions."""
    folder = scratch_folder(spark)
    regions = _read(spark, sf_dir, "region")
    for r in regions.collect():
        sinks.write_elements(folder, f"{r.r_name} x.csv", f"{r.r_name};{r.r_regionkey}", regions)
    return folder


@query("SELECT replace(r_name, ' ', '_') || '_x_elements.csv' AS name, length(r_name) + 2 AS size, true AS dated FROM region")
def q78_listed_elements(spark, sf_dir):  # noqa: ANN001, ANN201
    return tables.list_files(spark, _region_files(spark, sf_dir)).select("name", "size", (F.col("created") <= F.current_timestamp()).alias("dated"))


@query("SELECT replace(r_name, ' ', '_') || '_x_elements.csv' AS name, lower(replace(r_name, ' ', '-')) || '-x-elements' AS dataset, sha256(r_name || ';' || r_regionkey) AS fingerprint FROM region")
def q79_fingerprints(spark, sf_dir):  # noqa: ANN001, ANN201
    return policy.fingerprints(spark, _region_files(spark, sf_dir))


@query("SELECT 'policy' AS step, 'renamed.csv' AS name UNION ALL SELECT 'policy', r_name || '.csv' FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'policy', 'parsed_x.csv' UNION ALL SELECT 'seeded', r_name || '.csv' FROM region WHERE r_regionkey IN (0, 2)")
def q80_sharing_policy(spark, sf_dir):  # noqa: ANN001, ANN201
    name = F.concat("r_name", F.lit(".csv"))
    files = _read(spark, sf_dir, "region").select(name.alias("name"), policy.logical_id(name).alias("dataset"), F.sha2("r_name", 256).alias("fingerprint"), "r_regionkey")
    named = {r.r_regionkey: r for r in files.collect()}  # five
    files, none = files.drop("r_regionkey"), spark.createDataFrame([], "selector string")
    selectors = spark.createDataFrame([(f"parsed_{named[k].name}",) for k in (0, 2)], "selector string")
    seeded, known = policy.seed(spark.createDataFrame([], policy.MANIFEST), files, selectors, none)
    again, _ = policy.seed(seeded, files, selectors, known)  # each selector counts once
    manifest = policy.renamed(again, named[0].fingerprint, "renamed.csv")
    manifest = policy.inherited(policy.inherited(manifest, named[2].fingerprint, "f", "parsed_x.csv"), "unknown", "g", "never.csv")
    return manifest.select(F.lit("policy").alias("step"), "name").unionByName(seeded.select(F.lit("seeded").alias("step"), "name"))


@query("SELECT r_name || '.csv' AS name, r_regionkey::BIGINT AS key FROM region UNION ALL SELECT 'first', 1::BIGINT")
def q81_manifests_and_first_metadata(spark, sf_dir):  # noqa: ANN001, ANN201
    regions = _read(spark, sf_dir, "region")
    path = f"{scratch_folder(spark)}/manifest.json"
    sinks.write_json(path, {"files": [{"name": f"{r.r_name}.csv", "key": r.r_regionkey} for r in regions.collect()]}, regions)
    read = spark.read.schema("files array<struct<name: string, key: bigint>>").option("multiLine", True).json(path).select(F.inline("files"))
    files = spark.createDataFrame([("a.csv",), ("Catalog.ttl",), ("z.TTL",), ("y.ttl",)], "name string")
    picked = [tables.first_metadata(f).first()[0] for f in (files, files.where("name not in ('y.ttl', 'z.TTL')"), files.where("name = 'a.csv'"))]
    return read.select("name", F.col("key").cast("bigint").alias("key")).unionAll(spark.createDataFrame([("first", int(picked == ["y.ttl", "Catalog.ttl", "a.csv"]))], "name string, key bigint"))


@query("SELECT 'cleaned' AS file, upper(n_name) || '!' AS cell FROM nation UNION ALL SELECT 'parsed', CASE WHEN n_name < 'NATION_15' THEN 'early' ELSE '' END FROM nation UNION ALL SELECT 'report', v FROM (VALUES ('10'), ('50'), ('85'), ('100'), ('50 a.csv'), ('100 nations.xlsx'), ('1 left out')) t(v)")
def q82_cleaned_and_harmonised_files(spark, sf_dir):  # noqa: ANN001, ANN201
    names = sorted(r.n_name for r in _read(spark, sf_dir, "nation").collect())
    folder = scratch_folder(spark)
    path = _put(spark, f"{folder}/nations.xlsx", _workbook([[["name"], *[[f" {n.lower()}! "] for n in names]]]))
    steps: list[str] = []
    target = api.clean_file(spark, path, {"trimWhitespace": True, "standardizeCase": True, "caseMode": "upper"}, lambda percent, message="": steps.append(str(percent)))
    other = _put(spark, f"{folder}/a.csv", b"name\nx\n")
    rules = [({"==": [_ref("nations.xlsx", "name"), f"{n.lower()}!"]}, "early") for n in names if n < "NATION_15"]
    with warnings.catch_warnings(record=True) as left:
        warnings.simplefilter("always")
        (gone, made) = (f"{folder}/gone.csv", api.harmonize_files(spark, [other, path], {"mappings": [_standard("age", "nations.xlsx", ["name"], rules)]}, report=lambda percent, message="": steps.append(f"{percent} {message}")))
        api.harmonize_files(spark, [gone], {})
    steps.append(f"{sum('left out' in str(w.message) for w in left)} left out")
    if [posixpath.basename(p) for p in [target, *made]] != ["nations_cleaned.csv", "parsed_a.csv", "parsed_nations.csv"]:
        raise ValueError(f"unexpected names: {[target, *made]}")
    cleaned = tables.read_table(spark, target).select(F.lit("cleaned").alias("file"), F.col("name").alias("cell"))
    # blank lines are no rows of a csv file: the count of lines tells the rows without a value
    lines = spark.read.text(made[1]).where("value <> 'age'").select(F.lit("parsed").alias("file"), F.regexp_replace("value", '^""$', "").alias("cell"))
    return cleaned.unionByName(lines).unionByName(spark.createDataFrame([("report", s) for s in steps], "file string, cell string"))


@query("SELECT * FROM (VALUES ('count', 'DONE', (SELECT count(*) FROM nation)::VARCHAR), ('fetched again', 'GONE', NULL), ('error', 'ERROR', 'no luck'), ('its result', 'NOT READY', 'no luck'), ('cancel a finished one', 'DONE', 'false'), ('cancel an unknown one', 'CANCELED', 'true'), ('huge', 'DONE', '1')) t(step, state, answer)")
def q83_jobs(spark, sf_dir):  # noqa: ANN001, ANN201
    jobs = Jobs(spark)

    def fail(report):  # noqa: ANN001, ANN202
        raise ValueError("no luck")

    def ended(name: str):  # noqa: ANN202
        until = time.time() + 300
        while jobs.status(name).state == "RUNNING" and time.time() < until:
            time.sleep(0.05)
        return jobs.status(name)

    def answer(name: str) -> tuple[str, str | None]:
        try:
            return "DONE", str(jobs.result(name))
        except Gone:
            return "GONE", None
        except NotReady as error:
            return "NOT READY", str(error)

    good, bad = jobs.start(lambda report: _read(spark, sf_dir, "nation").count()), jobs.start(fail)
    out = [("cancel a finished one", ended(good).state, str(jobs.cancel(good)).lower()), ("count", *answer(good)), ("fetched again", *answer(good)), ("error", ended(bad).state, jobs.status(bad).message), ("its result", *answer(bad))]
    out.append(("cancel an unknown one", "CANCELED", str(jobs.cancel("none")).lower()))
    path = _put(spark, f"{scratch_folder(spark)}/huge.csv", b"a\n" + b"1\n" * 5000)
    started = api.profile_or_start(spark, jobs, [path])
    ended(started)
    out.append(("huge", "DONE", str(len(jobs.result(started)))))
    return spark.createDataFrame(out, "step string, state string, answer string")


@query("""SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_nationkey = 1 OR s_nationkey = 2 THEN 'either' ELSE '' END AS flat_and, CASE WHEN s_nationkey = 3 THEN 'one' ELSE '' END AS one_of, '' AS unsupported, '' AS elsewhere, CASE WHEN s_nationkey = 4 THEN 'own' ELSE '' END AS without_inputs,
    CASE WHEN s_nationkey = 5 THEN '1' ELSE '0' END AS hot, CASE WHEN s_nationkey BETWEEN 5 AND 10 THEN 'first' WHEN s_nationkey BETWEEN 8 AND 15 THEN 'second' ELSE '' END AS overlapping FROM supplier""")
def q84_mapping_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    file = "supplier.csv"
    key, other = _ref(file, "s_nationkey"), _ref("other.csv", "s_nationkey")
    whole = lambda target, *rules: _standard(target, file, ["s_nationkey"], list(rules))
    spec = {
        "ruleLanguage": "unread", "targetSchema": {"unread": True}, "sources": ["unread"], "datasetBindings": [{"unread": 1}],
        "mappings": [
            whole("key") | {"removeSourceColumns": True},
            whole("flat_and", ({"and": [{"==": [key, "1"]}, {"==": [key, "2"]}]}, "either")),
            whole("one_of", ({"in": [key, ["3"]]}, "one"), ({"in": [key, ["6", "7"]]}, "never")),
            whole("unsupported", ({"!=": [key, "1"]}, "never"), ({"!": [{"==": [key, "1"]}]}, "never"), ({"if": [{"==": [key, "1"]}, "a", "b"]}, "never"), ({"<": [key, 5]}, "never")),
            whole("elsewhere", ({"==": [other, "1"]}, "never")),
            {"mappingType": "standard", "targetField": "without_inputs", "rules": [{"logic": {"==": [key, "4"]}, "then": {"kind": "literal", "value": "own"}}]},
            {"mappingType": "one-hot", "inputs": [{"column": "s_nationkey"}], "outputs": [{"targetField": "hot", "logic": {"or": [{"==": [key, "5"]}, {"==": [_ref(file, "s_suppkey"), "1"]}]}}]},
            whole("overlapping", (_between(file, "s_nationkey", 5, 10), "first"), (_between(file, "s_nationkey", 8, 15), "second")),
            _standard("left_out", "other.csv", ["s_nationkey"], [({"==": [other, "1"]}, "never")]),
        ],
    }
    df = _read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumn("key", _c("s_suppkey"))
    return harmonize(df, spec, file)


@query("SELECT 0 AS columns, 'none.csv' AS file UNION ALL SELECT 1, 'supplier.csv'")
def q85_no_mapping_applies(spark, sf_dir):  # noqa: ANN001, ANN201
    spec = {"mappings": [_standard("key", "supplier.csv", ["s_suppkey"], [])]}
    found = {f: len(harmonize(_read(spark, sf_dir, "supplier", "s_suppkey"), spec, f).columns) for f in ("none.csv", "supplier.csv")}
    return spark.createDataFrame([(n, f) for f, n in found.items()], "columns int, file string")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, trunc(o_totalprice)::BIGINT AS price FROM orders")
def q86_cleaning_before_a_mapping(spark, sf_dir):  # noqa: ANN001, ANN201
    from loomgrid.plans.mapping import clean_for_mapping
    from loomgrid.functions import numeric

    df = _read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), "o_orderstatus", F.floor("o_totalprice").cast("string").alias("price"))
    df = df.unionAll(df.limit(3)).unionAll(spark.createDataFrame([(None, " ", "")], "day string, o_orderstatus string, price string"))
    df = clean_for_mapping(df, None, empty=True, duplicates=True).withColumns({"day": numeric.standard_date(_c("day"), "YYYY-MM-DD"), "price": numeric.standard_number(_c("price"), "int_round")})
    rule = ({"==": [_ref("o.csv", "o_orderstatus"), "F"]}, "done")
    done = harmonize(df, {"mappings": [_standard("day", "o.csv", ["day"], []), _standard("o_orderstatus", "o.csv", ["o_orderstatus"], [rule]), _standard("price", "o.csv", ["price"], [])]}, "o.csv")
    return done.withColumn("price", _c("price").cast("bigint"))


@query("SELECT r_name AS title, 'http://h/distribution/' || lower(replace(r_name, ' ', '-')) AS distribution, 'text/csv' AS media, '2020-01-0' || (r_regionkey + 1) AS issued, '2021-01-0' || (r_regionkey + 1) AS modified FROM region")
def q87_catalog_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    day = lambda year: F.concat(F.lit(f"{year}-01-0"), F.col("r_regionkey") + 1).cast("timestamp")
    regions = _read(spark, sf_dir, "region")
    files = regions.select(F.concat("r_name", F.lit(".csv")).alias("name"), day(2020).alias("modified")).unionAll(regions.select(F.concat(F.lit("parsed_"), "r_name", F.lit(".csv")), day(2021)))
    folder = scratch_folder(spark)
    written = metadata.catalog_turtle(metadata.dataset_groups(files), "http://h")
    written.coalesce(1).write.text(folder)  # a catalog of a folder's files
    triples = scratch(metadata.read_triples(spark, folder), "triples")
    own = metadata.datasets(triples).select(F.upper("title").alias("title"), F.substring("issued", 1, 10).alias("issued"), F.substring("modified", 1, 10).alias("modified"), F.explode("distributions").alias("distribution"))
    media = metadata.linked(triples, f"{metadata.DCAT}distribution", {"media": f"{metadata.DCAT}mediaType"}).select(F.col("o").alias("distribution"), "media")
    return own.join(media, "distribution").where("distribution not like '%/parsed-%'").select("title", "distribution", "media", "issued", "modified")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datasets, regions as catalogs: titles under several predicates, contacts as nested nodes."""
    nation = _read(spark, sf_dir, "nation")
    s, text = F.concat(F.lit("http://x/n"), "n_nationkey"), lambda c: F.struct(c.cast("string").alias("o"), F.lit("literal").alias("kind"))
    uri, blank = lambda c: F.struct(c.alias("o"), F.lit("uri").alias("kind")), lambda c: F.struct(c.alias("o"), F.lit("blank").alias("kind"))
    contact, address = F.concat(F.lit("_:c"), "n_nationkey"), F.concat(F.lit("_:a"), "n_nationkey")
    odd = F.col("n_nationkey") % 2 == 1
    rows = [
        (s, metadata.TYPE, uri(F.lit(f"{metadata.DCAT}Dataset")), F.lit(True)), (s, f"{metadata.DCT}title", text(_c("n_name")), odd), (s, "http://other/ns/title", text(F.lower("n_name")), F.lit(True)),
        (s, f"{metadata.DCAT}keyword", text(F.lit("b")), F.lit(True)), (s, "http://other/keyword", text(F.lit("a")), F.lit(True)), (s, "http://other/flag", text(F.when(odd, " TRUE ").otherwise("maybe")), F.lit(True)),
        (s, "http://other/size", text(F.when(odd, _c("n_nationkey").cast("string")).otherwise("many")), F.lit(True)), (s, f"{metadata.DCT}isPartOf", uri(F.concat(F.lit("http://x/r"), "n_regionkey")), odd),
        (s, f"{metadata.DCT}publisher", blank(contact), F.lit(True)), (contact, f"{metadata.DCT}title", text(_c("n_name")), F.lit(True)), (contact, "http://other/address", blank(address), F.lit(True)),
        (address, "http://other/city", text(F.lit("x")), F.lit(True)), (address, "http://other/city", text(F.lit("y")), F.lit(True)), (address, "http://other/of", blank(contact), F.lit(True)),
        (s, f"{metadata.DCT}issued", text(F.lit("2020-01-02")), F.lit(True)), (F.lit("http://x/r0"), metadata.TYPE, uri(F.lit(f"{metadata.DCAT}Catalog")), F.lit(True)), (F.lit("http://x/r9"), metadata.TYPE, uri(F.lit(f"{metadata.DCAT}Catalog")), F.lit(True)),
        (F.lit("http://x/r9"), f"{metadata.DCAT}dataset", uri(s), F.col("n_nationkey") % 4 == 0),
    ]
    each = F.array(*[F.struct(a.alias("s"), F.lit(p).alias("p"), o.alias("v"), use.alias("use")) for a, p, o, use in rows])
    return nation.select(F.explode(each).alias("t")).where("t.use").select(F.lit("f").alias("file"), "t.s", "t.p", "t.v.o", "t.v.kind").distinct()


@query("""SELECT 'http://x/n' || n_nationkey AS s, CASE WHEN odd THEN n_name ELSE lower(n_name) END AS title, 'b,a' AS keywords, CASE WHEN odd THEN true END AS flag, CASE WHEN odd THEN n_nationkey::BIGINT END AS size,
    CASE WHEN odd THEN 'http://x/r' || n_regionkey WHEN n_nationkey % 4 = 0 THEN 'http://x/r9' END AS parent, '1.0' AS version, '2020-01-02T00:00:00Z' AS issued, 'theme' AS themes FROM (SELECT *, n_nationkey % 2 = 1 AS odd FROM nation)""")
def q88_described_datasets(spark, sf_dir):  # noqa: ANN001, ANN201
    t = scratch(_described(spark, sf_dir), "triples")
    flag = metadata.first_property(t, "http://any/flag").select("s", metadata.to_boolean(_c("value")).alias("flag"))
    size = metadata.first_property(t, "http://any/size").select("s", metadata.to_long(_c("value")).alias("size"))
    done = metadata.completed(metadata.datasets(t), "theme", "publisher").join(flag, "s", "left").join(size, "s", "left").join(metadata.parents(t), "s", "left")
    return done.select("s", "title", F.array_join("keywords", ",").alias("keywords"), "flag", "size", "parent", "version", "issued", F.array_join("themes", ",").alias("themes"))


@query("""SELECT 'http://x/n' || n_nationkey AS s, '{"dct:publisher": {"dct:title": "' || n_name || '", "http://other/address": {"http://other/city": ["x", "y"], "http://other/of": "_:c' || n_nationkey || '"}}}' AS properties, 5 AS below FROM nation""")
def q89_nested_descriptions(spark, sf_dir):  # noqa: ANN001, ANN201
    t = scratch(_described(spark, sf_dir), "triples")
    below = metadata.closure(t, metadata.subjects_of_type(t)).where("level > 0").groupBy(F.col("start").alias("s")).agg(F.count(F.lit(1)).cast("int").alias("below"))
    return metadata.nested_properties(t, ["title", "keyword", "flag", "size", "isPartOf", "issued"]).join(below, "s").select("s", "properties", "below")


@query("SELECT 'http://x/n' || n_nationkey AS s, CASE WHEN n_nationkey % 2 = 1 THEN 'flag,keyword,size' ELSE 'flag,keyword,size' END AS names, 'http://here/n' || n_nationkey || '/spec' AS address, 'Dataset' AS local FROM nation")
def q90_additional_properties(spark, sf_dir):  # noqa: ANN001, ANN201
    t = _described(spark, sf_dir)
    rest = metadata.additional_properties(t.where("s like 'http://x/n%' and p like 'http://other/%'"), ["title"])
    address = metadata.rewritten(F.concat("s", F.lit("/metadata-schemas/01234567-89ab-cdef-0123-456789abcdef")), "http://x", "http://here")
    names = F.array_join(F.array_sort(F.transform(F.map_keys("properties"), metadata.local_name)), ",")
    return rest.select("s", names.alias("names"), address.alias("address"), metadata.local_name(F.lit(f"{metadata.DCAT}Dataset")).alias("local"))


@query("SELECT n_name || '.csv' AS name, lower(replace(n_name, '_', '-')) AS dataset, CASE n_nationkey % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/tab-separated-values' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END AS media FROM nation WHERE n_nationkey IN (4, 5, 6, 7)")
def q91_distributions(spark, sf_dir):  # noqa: ANN001, ANN201
    kinds = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".TSV", ".xlsx", ".doc")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    files, out = _read(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".csv")).alias("name"), F.concat("n_name", kinds).alias("other")), None
    for wanted in ("nation-4", "nation-5", "nation-6", "nation-7", "none"):
        found = metadata.distribution_of(files, wanted).select("name", F.lit(wanted).alias("dataset"), metadata.media_type(_c("other")).alias("media"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT a, sum(n) AS p FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS q FROM c GROUP BY 1),
    s AS (SELECT sum(power(coalesce(n, 0) - p * q / t, 2) / (p * q / t)) / 2 AS h, (count(DISTINCT x.a) - 1) * (count(DISTINCT y.b) - 1) AS df FROM x CROSS JOIN y CROSS JOIN (SELECT sum(n) AS t FROM c) LEFT JOIN c ON c.a = x.a AND c.b = y.b)
    SELECT df, round(CASE WHEN df % 2 = 0 THEN exp(-h) * list_sum(list_transform(range(0, (df // 2)::BIGINT), lambda k: power(h, k) / factorial(k::INTEGER))) END, 4) AS p_value FROM s""")
def q92_chi_square_p_value(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(pairwise.chi_square(_order_categories(spark, sf_dir)).select("df", "p_value"))


@query("SELECT 'a' AS feature1, 'b' AS feature2, true AS without_value")
def q93_a_category_without_partner(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") % 2).cast("string").alias("a"), F.when(F.col("n_nationkey") < 20, (F.col("n_nationkey") % 3).cast("string")).alias("b"))
    counts = pairwise.contingency(df, {"a": _c("a"), "b": _c("b")})
    categories = df.select(F.lit("a").alias("feature"), F.col("a").alias("value")).union(df.select(F.lit("b"), "b")).where("value is not null").distinct().unionAll(spark.createDataFrame([("a", "alone")], "feature string, value string"))
    return pairwise.chi_square(counts, categories).select("feature1", "feature2", F.isnan("p_value").alias("without_value"))


@query("SELECT 0 AS bin, printf('[%.6f - %.6f]', 7.0, 7.0) AS label, count(*) AS n FROM events")
def q94_constant_column(spark, sf_dir):  # noqa: ANN001, ANN201
    empty = prof.histogram(_read(spark, sf_dir, "events").select(F.lit(None).cast("double").alias("x")), _c("x")).select("bin", "label", "n")
    return prof.histogram(_read(spark, sf_dir, "events").select(F.lit(7.0).alias("x")), _c("x")).select("bin", "label", "n").unionByName(empty)


@query("""WITH c AS (SELECT o_orderpriority AS v FROM orders) SELECT 'Priority' AS feature, count(*) - count(*) FILTER (WHERE v = '5-LOW') AS present, count(*) FILTER (WHERE v = '5-LOW') AS missing, count(*) AS total FROM c""")
def q95_category_total(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(_c("o_orderpriority") != "5-LOW", _c("o_orderpriority")).alias("Priority (of an order)"))
    out = prof.profile(df, "o_orderkey")["missing"]
    return out.select("feature", (_c("total") - _c("missing")).alias("present"), "missing", "total")


@query("SELECT * FROM (VALUES ('d', 'dates', NULL), ('t', 'categories', NULL), ('u', NULL, 'This field cannot be converted to categorical.'), ('p.exe', NULL, 'files of type exe aren''t allowed'), ('filter', NULL, 'No matching records'), ('good', (SELECT count(*) FROM nation)::VARCHAR, NULL)) t(asked, found, message)")
def q96_forced_and_many_profiles(spark, sf_dir):  # noqa: ANN001, ANN201
    nations = [r.n_nationkey for r in _read(spark, sf_dir, "nation").collect()]
    folder = scratch_folder(spark)
    path = _put(spark, f"{folder}/n.csv", ("d,t (kind),u\n" + "".join(f"{datetime(2020, 1, k + 1):%Y-%m-%d},x,u{k}\n" for k in nations)).encode())
    out = []
    for name, kind, wanted in (("d", "continuous", "dates"), ("t", "categorical", "categories"), ("u", "categorical", "")):
        got = api.reprofile_file(spark, path, name, kind)
        out.append((name, None, got) if isinstance(got, str) else (name, wanted if wanted in got else "", None))
    good, bad = api.profile_files(spark, [path, f"{folder}/p.exe"])
    out += [("good", str(good["missing"].where("feature = 'd'").first()["present"]), None), ("p.exe", None, bad), ("filter", None, api.profile_file(spark, path, {"operator": "AND", "conditions": {"u": "none"}}))]
    return spark.createDataFrame(out, "asked string, found string, message string")


@query("SELECT * FROM (VALUES ('covariance', 0), ('pearson', 0), ('spearman', 0), ('two rows', 2)) t(measure, pairs)")
def q97_pairs_of_too_few_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("double").alias("a"), (F.col("r_regionkey") * 2.0).alias("b"))
    one, two = rows.where("a = 1"), rows.where("a < 2")
    found = {"covariance": pairwise.covariance(one, ["a", "b"]), "pearson": pairwise.pearson(one, ["a", "b"]), "spearman": pairwise.spearman(one, ["a", "b"]), "two rows": pairwise.pearson(two, ["a", "b"])}
    out = None
    for measure, pairs in found.items():
        counted = pairs.where("value is not null and not isnan(value)").agg(F.lit(measure).alias("measure"), F.count(F.lit(1)).cast("int").alias("pairs"))
        out = counted if out is None else out.unionByName(counted)
    return out


_KINDS = """v AS (SELECT {c} AS v, min({i}) AS pos, count(*) AS n FROM {f} WHERE trim({c}) <> '' GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY pos, v) AS k FROM v),
    g AS (SELECT 1 AS k, [(SELECT v FROM o WHERE k = 1)] AS seeds UNION ALL SELECT g.k + 1, CASE WHEN len(list_filter(g.seeds, lambda s: s = o.v OR 1 - levenshtein(s, o.v) / greatest(length(s), length(o.v)) >= {t})) > 0 THEN g.seeds ELSE list_append(g.seeds, o.v) END FROM g JOIN o ON o.k = g.k + 1),
    w AS (SELECT o.*, list_filter((SELECT seeds FROM g ORDER BY k DESC LIMIT 1), lambda s: s = o.v OR 1 - levenshtein(s, o.v) / greatest(length(s), length(o.v)) >= {t})[1] AS seed FROM o),
    b AS (SELECT seed, arg_max(v, (n, -k)) AS best FROM w GROUP BY seed) SELECT {i}, coalesce(b.best, p.{c}) AS kind FROM {f} p LEFT JOIN w ON w.v = p.{c} LEFT JOIN b ON b.seed = w.seed"""
ORACLES["q60_merge_similar_values"] = "WITH RECURSIVE " + _KINDS.format(t=0.8, c="p_type", i="p_partkey", f="part")


@query("WITH RECURSIVE " + _KINDS.format(t=0.9, c="s_name", i="s_suppkey", f="supplier"))
def q98_merge_in_blocks(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("kind"))
    return fuzzy.merge_similar_values(df, ["kind"], "s_suppkey", "levenshtein", 0.9, most=30)
