"""Reading csv, tsv and xlsx files as tables of text cells, and the screens that files pass first."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.scalars import all_of, any_of, blank
from loomgrid.operators.filters import filter_rows
from loomgrid.sources.display import GENERAL, display, number_formats

EXTENSIONS = ("csv", "tsv", "xlsx", "ttl")
#: What no screened text may contain.
FORBIDDEN = ("<script>", "<iframe>", "javascript:", "vbscript:")
_SCREENED = ("csv", "txt", "log")
_WINDOW = 4096
HUGE_BYTES, HUGE_ROWS = 1_000_000, 5_000
ROW = "__row"
_NUMBER = re.compile(r"-?\d+(\.\d*)?([eE][+-]?\d+)?")


class Refused(ValueError):
    """A file that isn't allowed or doesn't pass the screen."""


def extension(path: str) -> str:
    return posixpath.splitext(str(path))[1].lstrip(".").lower()


def _head(spark: SparkSession, path: str, lines: int) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(lines).collect()]


def detect_delimiter(lines: list[str]) -> str:
    """The most frequent of tab, semicolon and comma in the first five lines; the first of these if they tie."""
    counts = Counter("".join(lines[:5]))
    return max("\t;,", key=lambda d: (counts[d], -"\t;,".index(d))) if any(counts[d] for d in "\t;,") else ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file: the first record names the columns, all cells are text, surrounding space is cut.

    Quoted cells may hold line breaks; a file with any line of an odd number of quotes is read as a whole by one task,
    and one without is read in pieces. Short records are filled with nulls; empty lines are skipped. Column
    ``__row`` numbers the rows of a file in its order.
    """
    sep = delimiter or detect_delimiter(_head(spark, path, 5))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    broken = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", broken).option("mode", "PERMISSIVE")
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return reader.csv(path).withColumn(ROW, F.monotonically_increasing_id())


def _column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference).group():
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheets_of(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of each sheet of a workbook; numbers and dates as their formats show them, a missing cell is empty."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        formats = number_formats(book.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", ns)}
        root = ET.fromstring(book.read("xl/workbook.xml"))
        settings = root.find("m:workbookPr", ns)
        since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        for sheet in root.find("m:sheets", ns):
            target = targets[sheet.get(f"{{{ns['r']}}}id")]
            place = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows: list[list[str]] = []
            for row in ET.fromstring(book.read(place)).iter(f"{{{ns['m']}}}row"):
                cells: dict[int, str] = {}
                for k, cell in enumerate(row.findall("m:c", ns)):
                    at = _column_number(cell.get("r")) if cell.get("r") else k
                    kind, value = cell.get("t"), cell.findtext("m:v", None, ns)
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
                    elif value is None:
                        cells[at] = ""
                    elif kind == "s":
                        cells[at] = shared[int(value)]
                    elif kind == "b":
                        cells[at] = "TRUE" if value == "1" else "FALSE"
                    elif kind in (None, "n") and _NUMBER.fullmatch(value):
                        style = int(cell.get("s") or 0)
                        cells[at] = display(float(value), formats[style] if style < len(formats) else GENERAL, since_1904)
                    else:
                        cells[at] = value
                rows.append([cells.get(i, "").strip() for i in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def read_xlsx(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """All sheets of a workbook, each with its own header, one below the other; ``__row`` numbers the rows.

    A workbook is one zip file and is parsed by one task; several are parsed by several.
    """

    def cells(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, keys, values, files = 0, [], [], []
                for _, rows in sheets_of(content):
                    header = rows[0] if rows else []
                    for row in rows[1:]:
                        keys.append(n)
                        files.append(place)
                        values.append([(h, row[k] if k < len(row) else "") for k, h in enumerate(header) if h])
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(keys, pa.int64()), pa.array(values, pa.map_(pa.string(), pa.string()))], ["file", ROW, "cells"])

    from loomgrid.operators.ranks import scratch

    rows = scratch(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cells, f"file string, {ROW} bigint, cells map<string, string>"))
    headers = [r["h"] for r in rows.select(F.posexplode(F.map_keys("cells")).alias("k", "h")).groupBy("h").agg(F.min("k").alias("k")).orderBy("k", "h").collect()]
    out = rows.select(*[F.col("cells")[h].alias(h) for h in headers], ROW)
    return out.where(any_of([~blank(F.col(f"`{h}`")) for h in headers])) if skip_blank and headers else out


def read_table(spark: SparkSession, path: str, filter_tree: dict | None = None, screen: bool = True) -> DataFrame:
    """A csv, tsv or xlsx file as text cells, screened, and filtered if a filter is given."""
    kind = extension(path)
    if kind not in EXTENSIONS:
        raise Refused(f"files of type {kind or 'none'} aren't allowed")
    if screen and not passes_screen(spark, path):
        raise Refused(f"{path} holds forbidden content")
    table = read_xlsx(spark, path) if kind == "xlsx" else read_csv(spark, path)
    return filter_rows(table, filter_tree)


def clean_text(c):  # noqa: ANN001, ANN201
    """Whether a text holds nothing that is forbidden; null passes."""
    return all_of([~F.coalesce(F.contains(c, F.lit(x)), F.lit(False)) for x in FORBIDDEN])


def passes_screen(spark: SparkSession, path: str) -> bool:
    """csv, txt and log files are searched line by line, xlsx files in their first 4096 bytes, others not at all."""
    kind = extension(path)
    if kind in _SCREENED:
        return spark.read.text(path).where(~clean_text(F.col("value"))).isEmpty()
    if kind == "xlsx":
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, _WINDOW).cast("string").alias("head"))
        return head.where(~clean_text(F.col("head"))).isEmpty()
    return True


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, size, created, modified) of a folder's files, by name whatever the case; contents aren't read.

    Only local file systems tell when a file was made; elsewhere ``created`` is ``modified``.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    nio = spark._jvm.java.nio.file
    born = []
    for row in files.where(F.startswith("path", F.lit("file:"))).select("path").collect():  # a listing, which the driver makes anyway
        place = nio.Paths.get(spark._jvm.org.apache.hadoop.fs.Path(row["path"]).toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
        time = nio.Files.getAttribute(place, "creationTime", spark.sparkContext._gateway.new_array(nio.LinkOption, 0))
        born.append((row["path"], time.toMillis()))
    made = spark.createDataFrame(born, "path string, born bigint")
    files = files.join(F.broadcast(made), "path", "left")  # a row for each listed file of this machine
    out = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "size", F.coalesce(F.timestamp_millis("born"), "modified").alias("created"), "modified")
    return out.orderBy(F.lower("name"), "name")


def first_metadata(files: DataFrame, managed: str = "catalog.ttl") -> DataFrame:
    """The metadata file to use: the first .ttl that isn't managed, else the first .ttl, else the first file."""
    ttl = F.lower(F.col("name")).endswith(".ttl")
    rank = F.when(ttl & (F.lower("name") != managed.lower()), 0).when(ttl, 1).otherwise(2)
    return files.orderBy(rank, F.lower("name")).limit(1)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def estimated_rows(spark: SparkSession, path: str) -> int:
    """Line breaks less one of a delimited file; for a workbook, the rows that the sheets' dimension tags announce."""
    if extension(path) != "xlsx":
        return max(0, spark.read.option("lineSep", "\n").text(path).count() - 1)
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    total = 0
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for name in book.namelist():
            if name.startswith("xl/worksheets/sheet"):
                with book.open(name) as sheet:
                    found = re.search(rb'<dimension ref="[A-Z]+(\d+):[A-Z]+(\d+)"', sheet.read(65_536))
                total += max(0, int(found.group(2)) - int(found.group(1))) if found else 0
    return total


def is_huge(spark: SparkSession, path: str) -> bool:
    """Whether a file is profiled in the background: a megabyte, or five thousand rows."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return size >= HUGE_BYTES or estimated_rows(spark, path) >= HUGE_ROWS
