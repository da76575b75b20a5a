"""Writing tables as delimited files, and the names of what is written."""

from __future__ import annotations

import json
import posixpath
import re
import uuid

from pyspark.sql import DataFrame

from loomgrid.sources.tables import ROW, extension


def cleaned_path(path: str) -> str:
    """Where a cleaned file goes: in place, or for a workbook beside it as csv."""
    return f"{path[: -len('.xlsx')]}_cleaned.csv" if extension(path) == "xlsx" else path


def parsed_path(path: str) -> str:
    """Where a harmonised file goes: parsed_<stem>.csv beside its source."""
    folder, name = posixpath.split(path)
    return posixpath.join(folder, f"parsed_{posixpath.splitext(name)[0]}.csv")


def elements_name(name: str) -> str:
    """The name of a dataset's dictionary of elements: other signs than letters, digits, dots, hyphens and underscores become underscores."""
    safe = re.sub(r"[^a-zA-Z0-9._-]", "_", name)
    return re.sub(r"(?i)\.(csv|xlsx)$", "", safe) + "_elements.csv"


def _file_system(df: DataFrame, path: str):  # noqa: ANN202
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path, jvm, conf


def write_folder(df: DataFrame, path: str, sep: str = ";") -> None:
    """A folder of delimited part files with headers: the form for large tables."""
    df.drop(ROW).write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_file(df: DataFrame, path: str, sep: str = ";", keep_if_empty: bool = True) -> bool:
    """One delimited file, written beside its place and then moved there; without rows the old file stays.

    Cells with the separator, quotes or line breaks are quoted. Says whether a file was written.
    """
    table = df.drop(ROW)
    if keep_if_empty and table.isEmpty():
        return False
    fs, place, jvm, conf = _file_system(df, path)
    work = f"{path}.{uuid.uuid4().hex}.tmp"
    if not table.columns:
        out = fs.create(place(path), True)
        out.write(bytearray(b"\n"))
        out.close()
        return True
    ordered = table if ROW not in df.columns else df.orderBy(ROW).drop(ROW)
    blank = "" if len(table.columns) > 1 else '""'  # an empty line would be no row
    ordered.coalesce(1).write.option("sep", sep).option("header", True).option("emptyValue", blank).option("nullValue", blank).option("quote", '"').option("escape", '"').csv(work)
    parts = [s.getPath() for s in fs.listStatus(place(work)) if s.getPath().getName().startswith("part-")]
    target = place(path)
    if parts:  # the new file takes the old one's place in one step, so that there's always one of them
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        instead = df.sparkSession.sparkContext._gateway.new_array(kinds, 1)
        instead[0] = kinds.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(parts[0]), fs.makeQualified(target), instead)
    fs.delete(place(work), True)
    return True


def write_elements(folder: str, name: str, text: str, like: DataFrame) -> str:
    """Writes a dataset's dictionary of elements as it is given and returns its path."""
    path = posixpath.join(folder, elements_name(name))
    fs, place, _, _ = _file_system(like, path)
    out = fs.create(place(path), True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def write_json(path: str, manifest: dict, like: DataFrame) -> None:
    """A small manifest as one JSON file."""
    fs, place, _, _ = _file_system(like, path)
    out = fs.create(place(path), True)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False, indent=1).encode()))
    out.close()
