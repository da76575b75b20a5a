"""Catalog metadata: triples as a table, dataset descriptions from them, and catalogs written from file listings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DCAT, DCT, RDF = "http://www.w3.org/ns/dcat#", "http://purl.org/dc/terms/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
PREFIXES = {"dcat": DCAT, "dct": DCT, "rdf": RDF, "foaf": "http://xmlns.com/foaf/0.1/", "xsd": "http://www.w3.org/2001/XMLSchema#"}
TYPE = f"{RDF}type"
_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<uri><[^<>\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')|(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<lang>@[a-zA-Z][a-zA-Z0-9-]*)|(?P<kind>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)(?![\w:]))|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:)|(?P<word>[a-zA-Z]+)|(?P<sign>[;,.\[\]()])', re.S)
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)')


def triples_of(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(subject, predicate, object, kind of object) of a Turtle or N-Triples text; kind is uri, blank or literal."""
    prefixes: dict[str, str] = {}
    base, made, at = "", 0, 0
    tokens: list[tuple[str, str]] = []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unreadable metadata at character {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    k = 0

    def unescape(s: str) -> str:
        plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
        return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), s)

    def uri(kind: str, token: str) -> str:
        if kind == "uri":
            inner = token[1:-1]
            return inner if re.match(r"[a-zA-Z][\w+.-]*:", inner) else base + inner
        prefix, _, local = token.partition(":")
        return prefixes.get(prefix, PREFIXES.get(prefix, f"{prefix}:")) + local

    def term(out: list) -> tuple[str, str]:
        nonlocal k, made
        kind, token = tokens[k]
        k += 1
        if kind in ("uri", "name"):
            return uri(kind, token), "uri"
        if kind == "blank":
            return token, "blank"
        if (kind, token) == ("sign", "["):
            made += 1
            own = f"_:g{made}"
            if tokens[k] != ("sign", "]"):
                described(own, out)
            k += 1
            return own, "blank"
        if (kind, token) == ("sign", "("):
            items = []
            while tokens[k] != ("sign", ")"):
                items.append(term(out))
            k += 1
            first = f"{RDF}nil"
            for value, what in reversed(items):
                made += 1
                out += [(f"_:g{made}", f"{RDF}first", value, what), (f"_:g{made}", f"{RDF}rest", first, "uri" if first.endswith("nil") else "blank")]
                first = f"_:g{made}"
            return first, "blank" if items else "uri"
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            value = unescape(token[cut:-cut])
            if k < len(tokens) and tokens[k][0] == "lang":
                k += 1
            elif k < len(tokens) and tokens[k][0] == "kind":
                k += 2
            return value, "literal"
        return token, "literal"

    def described(subject: str, out: list) -> None:
        nonlocal k
        while True:
            kind, token = tokens[k]
            k += 1
            predicate = TYPE if (kind, token) == ("word", "a") else uri(kind, token)
            while True:
                value, what = term(out)
                out.append((subject, predicate, value, what))
                if k < len(tokens) and tokens[k] == ("sign", ","):
                    k += 1
                    continue
                break
            while k < len(tokens) and tokens[k] == ("sign", ";"):
                k += 1
                if k >= len(tokens) or tokens[k][1] in (".", "]"):
                    return
                break
            else:
                return

    while k < len(tokens):
        kind, token = tokens[k]
        if token.lower() in ("@prefix", "prefix"):
            prefixes[tokens[k + 1][1][:-1]] = uri(*tokens[k + 2])
            k += 3
        elif token.lower() in ("@base", "base"):
            base = tokens[k + 1][1][1:-1]
            k += 2
        else:
            out: list = []
            subject, _ = term(out)
            if k < len(tokens) and tokens[k] != ("sign", "."):
                described(subject, out)
            yield from out
        if k < len(tokens) and tokens[k] == ("sign", "."):
            k += 1


def triples_of_xml(text: str) -> Iterator[tuple[str, str, str, str]]:
    """The triples of an RDF/XML text: typed and nested nodes, resource links, literals and attributes as properties."""
    import xml.etree.ElementTree as ET

    made = 0

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(e: ET.Element, out: list) -> str:
        nonlocal made
        subject = e.get(f"{{{RDF}}}about") or (f"#{e.get(f'{{{RDF}}}ID')}" if e.get(f"{{{RDF}}}ID") else None) or (f"_:{e.get(f'{{{RDF}}}nodeID')}" if e.get(f"{{{RDF}}}nodeID") else None)
        if subject is None:
            made += 1
            subject = f"_:x{made}"
        if name(e.tag) != f"{RDF}Description":
            out.append((subject, TYPE, name(e.tag), "uri"))
        out += [(subject, name(k), v, "literal") for k, v in e.attrib.items() if k.startswith("{") and not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/"))]
        properties(subject, e, out)
        return subject

    def properties(subject: str, parent: ET.Element, out: list) -> None:
        nonlocal made
        for p in parent:
            if (link := p.get(f"{{{RDF}}}resource")) is not None:
                out.append((subject, name(p.tag), link, "uri"))
            elif (link := p.get(f"{{{RDF}}}nodeID")) is not None:
                out.append((subject, name(p.tag), f"_:{link}", "blank"))
            elif p.get(f"{{{RDF}}}parseType") == "Resource":
                made += 1
                own = f"_:x{made}"
                out.append((subject, name(p.tag), own, "blank"))
                properties(own, p, out)
            elif len(p):
                for child in p:
                    below = node(child, out)
                    out.append((subject, name(p.tag), below, "blank" if below.startswith("_:") else "uri"))
            else:
                out.append((subject, name(p.tag), (p.text or "").strip(), "literal"))

    root, out = ET.fromstring(text), []
    for e in root if name(root.tag) == f"{RDF}RDF" else [root]:
        node(e, out)
    yield from out


def triples_of_json(text: str) -> Iterator[tuple[str, str, str, str]]:
    """The triples of a JSON-LD text with an inline context of prefixes and terms; remote contexts aren't fetched."""
    import json

    made, out = 0, []

    def full(name: str, context: dict) -> str:
        term = context.get(name)
        if isinstance(term, dict):
            term = term.get("@id")
        if isinstance(term, str) and term != name:
            return full(term, context)
        prefix, found, local = name.partition(":")
        if found and not local.startswith("//"):
            space = context.get(prefix, PREFIXES.get(prefix))
            if isinstance(space, str):
                return space + local
        return name if found or name.startswith("@") else str(context.get("@vocab", "")) + name

    def value(subject: str, predicate: str, v: object, context: dict, link: bool) -> None:
        if isinstance(v, list):
            for x in v:
                value(subject, predicate, x, context, link)
        elif isinstance(v, dict) and "@value" in v:
            out.append((subject, predicate, _plain(v["@value"]), "literal"))
        elif isinstance(v, dict) and "@list" in v:
            value(subject, predicate, v["@list"], context, link)
        elif isinstance(v, dict):
            own = node(v, context)
            out.append((subject, predicate, own, "blank" if own.startswith("_:") else "uri"))
        elif v is not None:
            out.append((subject, predicate, full(v, context) if link else _plain(v), "uri" if link else "literal"))

    def node(item: dict, context: dict) -> str:
        nonlocal made
        if isinstance(own := item.get("@context"), (dict, list)):
            for part in own if isinstance(own, list) else [own]:
                context = context | (part if isinstance(part, dict) else {})
        subject = item.get("@id")
        if subject is None:
            made += 1
            subject = f"_:j{made}"
        subject = full(subject, context)
        kinds = item.get("@type", [])
        out.extend((subject, TYPE, full(k, context), "uri") for k in (kinds if isinstance(kinds, list) else [kinds]))
        for k, v in item.items():
            if not k.startswith("@"):
                term = context.get(k)
                value(subject, full(k, context), v, context, isinstance(term, dict) and term.get("@type") == "@id")
        for x in item.get("@graph", []):
            node(x, context)
        return subject

    data = json.loads(text)
    for item in data if isinstance(data, list) else [data]:
        node(item, {})
    yield from (t for t in out)


def _plain(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def triples_of_file(name: str, text: str) -> list[tuple[str, str, str, str]]:
    """The triples of a file: its extension's syntax first, then Turtle (which N-Triples is part of), JSON-LD, RDF/XML."""
    by = {"jsonld": triples_of_json, "json": triples_of_json, "rdf": triples_of_xml, "xml": triples_of_xml, "owl": triples_of_xml}
    first = by.get(name.rsplit(".", 1)[-1].lower(), triples_of)
    error: Exception | None = None
    for syntax in dict.fromkeys([first, triples_of, triples_of_json, triples_of_xml]):
        try:
            return list(syntax(text))
        except Exception as e:
            error = error or e
    raise ValueError(f"{name} can't be read as metadata: {error}")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(file, s, p, o, kind): the triples of Turtle, N-Triples, JSON-LD and RDF/XML files, a file to a task."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            rows = [(f, *t) for f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in triples_of_file(f, text or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 5)], ["file", "s", "p", "o", "kind"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, "file string, s string, p string, o string, kind string")


def local_name(uri: Column) -> Column:
    """What follows the last #, else the last /."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def subjects_of_type(triples: DataFrame, kind: str = f"{DCAT}Dataset") -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select("s").distinct()


def first_property(triples: DataFrame, uri: str) -> DataFrame:
    """(s, value): the value of the exact predicate, else of one with the same local name; the least of several."""
    name = re.split(r"[#/]", uri)[-1]
    rank = F.when(F.col("p") == uri, 0).when(local_name(F.col("p")) == name, 1)
    return triples.withColumn("rank", rank).where("rank is not null").groupBy("s").agg(F.min(F.struct("rank", "o")).alias("b")).select("s", F.col("b.o").alias("value"))


def all_properties(triples: DataFrame, uri: str) -> DataFrame:
    """(s, values): values of the exact predicate before those with the same local name."""
    name = re.split(r"[#/]", uri)[-1]
    rank = F.when(F.col("p") == uri, 0).when(local_name(F.col("p")) == name, 1)
    found = triples.withColumn("rank", rank).where("rank is not null").groupBy("s").agg(F.array_sort(F.collect_set(F.struct("rank", "o"))).alias("v"))
    return found.select("s", F.transform("v", lambda x: x["o"]).alias("values"))


def to_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def to_long(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def compact(uri: Column) -> Column:
    """A predicate with a known prefix instead of its name space."""
    out = uri
    for prefix, space in PREFIXES.items():
        out = F.when(F.startswith(uri, F.lit(space)), F.concat(F.lit(f"{prefix}:"), F.substring(uri, F.lit(len(space) + 1), F.length(uri)))).otherwise(out)
    return out


def additional_properties(triples: DataFrame, known: list[str]) -> DataFrame:
    """(s, properties): what a description says beyond the known names, by compact predicate."""
    rest = triples.where(~local_name(F.col("p")).isin(known) & (F.col("p") != TYPE)).groupBy("s", compact(F.col("p")).alias("k")).agg(F.array_sort(F.collect_set("o")).alias("v"))
    return rest.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def closure(triples: DataFrame, starts: DataFrame, depth: int = 3, kinds: tuple[str, ...] = ("blank",)) -> DataFrame:
    """(start, s, p, o, kind, level): what the starts and the nodes of ``kinds`` below them say, down to ``depth``, without cycles."""
    step = triples.join(starts.select(F.col("s").alias("start"), "s"), "s").select("start", "s", "p", "o", "kind", F.lit(0).alias("level"), F.array("s").alias("seen"))
    out = step
    for level in range(1, depth + 1):
        below = step.where(F.col("kind").isin(*kinds) & ~F.array_contains("seen", F.col("o"))).select("start", F.col("o").alias("s"), F.concat("seen", F.array("o")).alias("seen")).distinct()
        step = triples.join(below, "s").select("start", "s", "p", "o", "kind", F.lit(level).alias("level"), "seen")
        out = out.unionByName(step)
    return out.drop("seen").distinct()


def short_name(uri: str) -> str:
    """:func:`compact` of one address."""
    return next((f"{prefix}:{uri[len(space) :]}" for prefix, space in reversed(PREFIXES.items()) if uri.startswith(space)), uri)


def add_value(target: dict, key: str, value: object) -> None:
    """One value stays as it is, several become a list."""
    if key not in target:
        target[key] = value
    elif isinstance(target[key], list):
        target[key].append(value)
    else:
        target[key] = [target[key], value]


def expanded(value: str, kind: str, said: dict[str, list[tuple[str, str, str]]], depth: int = 3, seen: set[str] | None = None) -> object:
    """A node as nested objects: what ``said`` tells of it, ``depth`` levels down; a node that was seen before is its name.

    Properties come in the order of their addresses, values in their own order.
    """
    seen = set() if seen is None else seen
    if kind == "literal" or depth == 0 or value in seen:
        return value
    seen.add(value)
    rows = said.get(value, [])
    if not rows:
        return value
    out: dict = {"uri": value} if kind == "uri" else {}
    for p, o, what in sorted(rows):
        add_value(out, short_name(p), expanded(o, what, said, depth - 1, seen))
    return out


def nested_properties(triples: DataFrame, known: list[str], depth: int = 3) -> DataFrame:
    """(s, properties): what each dataset's description says beyond the known names, as JSON with nested objects.

    A task holds the surroundings of one description, ``depth`` links far.
    """
    around = closure(triples, subjects_of_type(triples), depth, ("blank", "uri"))

    def objects(frame):  # noqa: ANN001, ANN202
        import json

        import pandas as pd

        start, said, out = frame["start"].iloc[0], {}, {}
        for s, p, o, kind in sorted(set(zip(frame["s"], frame["p"], frame["o"], frame["kind"]))):
            said.setdefault(s, []).append((p, o, kind))
        for p, o, kind in said.get(start, []):
            if p != TYPE and re.split(r"[#/]", p)[-1] not in known:
                add_value(out, short_name(p), expanded(o, kind, said, depth))
        return pd.DataFrame({"s": [start], "properties": [json.dumps(out, ensure_ascii=False, sort_keys=True)]})

    return around.groupBy("start").applyInPandas(objects, "s string, properties string")


def datasets(triples: DataFrame) -> DataFrame:
    """One row for each described dataset: (s, title, description, version, issued, modified, publisher, themes, keywords, distributions, variables)."""
    out = subjects_of_type(triples)
    for name, uri in (("title", f"{DCT}title"), ("description", f"{DCT}description"), ("version", f"{DCAT}version"), ("issued", f"{DCT}issued"), ("modified", f"{DCT}modified"), ("publisher", f"{DCT}publisher")):
        out = out.join(first_property(triples, uri).withColumnRenamed("value", name), "s", "left")
    for name, uri in (("themes", f"{DCAT}theme"), ("keywords", f"{DCAT}keyword"), ("distributions", f"{DCAT}distribution"), ("variables", f"{DCAT}variable")):
        out = out.join(all_properties(triples, uri).withColumnRenamed("values", name), "s", "left")
    return out


def linked(triples: DataFrame, predicate: str, properties: dict[str, str]) -> DataFrame:
    """(s, o, and the named properties of o) of resources linked by a predicate, such as distributions and variables."""
    out = triples.where((F.col("p") == predicate) | (local_name(F.col("p")) == re.split(r"[#/]", predicate)[-1])).select("s", "o").distinct()
    for name, uri in properties.items():
        out = out.join(first_property(triples, uri).select(F.col("s").alias("o"), F.col("value").alias(name)), "o", "left")
    return out


def parents(triples: DataFrame, inverse: str = f"{DCAT}dataset") -> DataFrame:
    """(s, parent) of datasets: what isPartOf says, else who links to it, else the only catalog there is."""
    own = subjects_of_type(triples)
    stated = first_property(triples, f"{DCT}isPartOf").withColumnRenamed("value", "stated")
    linking = triples.where(F.col("p") == inverse).groupBy(F.col("o").alias("s")).agg(F.min(triples["s"]).alias("linking"))
    only = subjects_of_type(triples, f"{DCAT}Catalog").agg(F.when(F.count(F.lit(1)) == 1, F.min("s")).alias("only"))
    joined = own.join(stated, "s", "left").join(linking, "s", "left").crossJoin(F.broadcast(only))  # one row
    return joined.select("s", F.coalesce("stated", "linking", "only").alias("parent")).where("parent is not null")


def completed(descriptions: DataFrame, theme: str, publisher: str) -> DataFrame:
    """Descriptions with the defaults that a catalog wants: title, version, theme, publisher, and dates with a time."""
    stamped = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.col(c), F.lit("T00:00:00Z"))).otherwise(F.col(c))
    return descriptions.withColumns({
        "title": F.coalesce("title", local_name(F.col("s"))), "version": F.coalesce("version", F.lit("1.0")), "publisher": F.coalesce("publisher", F.lit(publisher)),
        "themes": F.coalesce("themes", F.array(F.lit(theme))), "issued": stamped("issued"), "modified": stamped("modified"),
    })


def rewritten(c: Column, instance: str, local: str) -> Column:
    """Addresses of one instance as those of another; paths of schemas by id become /spec."""
    return F.regexp_replace(F.replace(c, F.lit(instance), F.lit(local)), r"/metadata-schemas/[0-9a-fA-F-]{36}", "/spec")


# Catalogs from file listings.


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def group_name(name: Column) -> Column:
    """A file's dataset: its name without extension and without a leading parsed_ or parsed-."""
    return F.regexp_replace(stem(name), r"(?i)^parsed[_-]", "")


def slug(c: Column) -> Column:
    """Lower case, other characters than letters and digits as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def title(c: Column) -> Column:
    """Words with a capital first letter; the rest stays as it is."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def media_type(name: Column) -> Column:
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(kind == "csv", "text/csv").when(kind == "tsv", "text/tab-separated-values").when(kind == "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").otherwise("application/octet-stream")


def dataset_groups(files: DataFrame) -> DataFrame:
    """(dataset, slug, files, issued, modified) of a listing (name, modified): originals before derived files, then by name."""
    derived = F.lower(F.col("name")).rlike(r"^parsed[_-]").cast("int")
    named = files.withColumn("dataset", F.lower(group_name(F.col("name")))).withColumn("entry", F.struct(derived.alias("derived"), F.lower("name").alias("low"), "name"))
    grouped = named.groupBy("dataset").agg(F.array_sort(F.collect_list("entry")).alias("e"), F.min("modified").alias("issued"), F.max("modified").alias("modified"))
    return grouped.select("dataset", slug(F.col("dataset")).alias("slug"), F.transform("e", lambda x: x["name"]).alias("files"), "issued", "modified")


def distribution_of(files: DataFrame, wanted: str) -> DataFrame:
    """The files whose stem has the slug ``wanted``."""
    return files.where(slug(stem(F.col("name"))) == wanted)


def catalog_turtle(groups: DataFrame, base: str, catalog: str = "catalog") -> DataFrame:
    """(value): one Turtle statement for each dataset, each distribution, and the catalog's link to them."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    own = F.concat(F.lit(f"<{base}/dataset/"), "slug", F.lit(">"))
    when = lambda c: F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f'"^^<{PREFIXES["xsd"]}dateTime>'))
    about = F.concat(own, F.lit(f" a <{DCAT}Dataset> ; <{DCT}title> "), quoted(title(F.col("dataset"))), F.lit(f" ; <{DCT}issued> "), when("issued"), F.lit(f" ; <{DCT}modified> "), when("modified"), F.lit(" ."))
    linkage = F.concat(F.lit(f"<{base}/{catalog}> <{DCAT}dataset> "), own, F.lit(" ."))
    one = groups.select(own.alias("own"), F.explode("files").alias("name"))
    place = F.concat(F.lit(f"<{base}/distribution/"), slug(stem(F.col("name"))), F.lit(">"))
    parts = one.select(F.concat(F.col("own"), F.lit(f" <{DCAT}distribution> "), place, F.lit(f" .\n"), place, F.lit(f" a <{DCAT}Distribution> ; <{DCT}title> "), quoted(F.col("name")), F.lit(f" ; <{DCAT}mediaType> "), quoted(media_type(F.col("name"))), F.lit(" .")).alias("value"))
    return groups.select(about.alias("value")).unionAll(groups.select(linkage.alias("value"))).unionAll(parts)
