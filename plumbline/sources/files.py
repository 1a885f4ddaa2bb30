"""Delimited text, JSON and workbooks as tables of strings; '' is missing.

Only the head of a file is looked at on the driver. The rest is read by Spark: delimited text in
splits (unless quoted cells hold line feeds), a workbook by the task that unzips it.
"""

from __future__ import annotations

import csv
import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import sniff
from plumbline.sources.sniff import IngestReport

HELPER_SHEETS = r"(?i)\b(check|notes|readme|meta|temp|tmp|qa|pivot|lookup|dropdown|list|ref|scratch|working|calc)"
HELPER_PENALTY = 0.6
_ROW = "sheet string, number int, cells array<string>"


def head(spark: SparkSession, path: str, n: int = sniff.HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of a folder's first part, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(where).isDirectory():
        parts = sorted(f.getPath().toString() for f in store.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not parts:
            return b""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts[0])
    stream = store.open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory())


def read_csv_like(spark: SparkSession, path: str, keep_row_ids: bool = False) -> tuple[DataFrame, IngestReport]:
    """Delimited text: encoding, delimiter and header rows sniffed; ragged rows padded and trimmed; empty columns dropped.

    With keep_row_ids a column _row_id rises in file order. A table whose labels run down its first
    column is turned, if it fits the head of the file. A folder is one table written in parts, each
    with one header row.
    """
    first = head(spark, path)
    report = IngestReport("delimited", encoding=sniff.encoding(first))
    text = first.decode(report.encoding, errors="replace")
    if len(first) == sniff.HEAD_BYTES:
        text = text.rpartition("\n")[0]
    report.delimiter = sniff.delimiter(text[:65536])
    grid = [r for _, r in zip(range(sniff.ROWS), csv.reader(io.StringIO(text), delimiter=report.delimiter), strict=False)]
    columns, start, above = sniff.layout(grid)
    report.orientation = sniff.orientation(grid[len(above) :])
    if columns and is_folder(spark, path):
        options = {"header": "true", "sep": report.delimiter, "quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": "", "multiLine": str(any("\n" in c for r in grid for c in r)).lower()}
        parts = spark.read.options(**options).csv(path)
        report.header_row, report.data_row, report.columns = 1, 2, len(parts.columns)
        return parts.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in parts.columns]), report
    if report.orientation == "transposed" and len(grid) < sniff.ROWS and len(first) < sniff.HEAD_BYTES:
        turned = [list(r) for r in zip(*[r + [""] * (max(map(len, grid)) - len(r)) for r in grid[len(above) :] if any(c.strip() for c in r)], strict=True)]
        columns, report.skipped_rows, report.columns = sniff.names(turned[0]), above, len(turned[0])
        report.notes.append("turned: labels ran down the first column")
        return spark.createDataFrame([tuple(r) for r in turned[1:]], ", ".join(f"`{c}` string" for c in columns)), report
    if not columns:
        return spark.createDataFrame([], T.StructType([])), report
    multi = any("\n" in c for r in grid for c in r)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    codec = {"utf-8-sig": "UTF-8", "utf-16": "UTF-16"}.get(report.encoding, report.encoding)
    options = {"sep": report.delimiter, "encoding": codec, "header": "false", "mode": "PERMISSIVE", "multiLine": str(multi or codec == "UTF-16").lower(), "quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "enforceSchema": "true"}
    raw = spark.read.schema(schema).options(**options).csv(path)
    # blank lines are no rows to Spark, so those above the data don't count
    skip = sum(1 for r in grid[:start] if r)
    place = F.monotonically_increasing_id()
    here = raw.select("*", place.alias("_row_id"), F.col("_metadata.file_block_start").alias("__at"))
    body = here.where(~((F.col("__at") == 0) & (F.col("_row_id").bitwiseAND((1 << 33) - 1) < skip))).drop("__at")
    named = body.select(*([F.col("_row_id")] if keep_row_ids else []), *[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for i, n in enumerate(columns)])
    out = drop_empty_columns(named, report)
    report.header_row, report.data_row, report.skipped_rows, report.columns = max(0, start - 1) + 1, start + 1, above, len(out.columns)
    return out, report


def drop_empty_columns(df: DataFrame, report: IngestReport | None = None) -> DataFrame:
    """Without the columns that have no value, found by one aggregation."""
    text = [c for c in df.columns if c != "_row_id"]
    if not text:
        return df
    row = df.agg(*[F.max((F.trim(F.col(f"`{c}`")) != "").cast("int")).alias(f"m{i}") for i, c in enumerate(text)]).first()
    empty = [c for c, m in zip(text, row, strict=True) if m == 0]
    if report and empty:
        report.notes.append(f"empty columns dropped: {', '.join(empty)}")
    return df.drop(*empty)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> tuple[DataFrame, IngestReport]:
    """Records of a JSON array, of the first list of an object, of lines, or one object; nested names dotted, all text."""
    start = head(spark, path, 4096).lstrip()
    if lines is None:
        lines = path.endswith((".ndjson", ".jsonl")) or (start.startswith(b"{") and bool(re.match(rb"\{.*\}\s*\n\s*\{", start)))
    df = spark.read.option("multiLine", str(not lines).lower()).option("primitivesAsString", "true").json(path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if start.startswith(b"{") and not lines and lists:
        df = df.select(F.inline(F.col(f"`{lists[0]}`")))
    out = flatten(df)
    return out, IngestReport("json", columns=len(out.columns))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns a.b.c; lists stay lists; everything else is text, null as ''."""

    def leaves(schema: T.StructType, path: str, name: str) -> Iterator:
        for f in schema.fields:
            at, label = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{at}.", f"{label}.")
            elif isinstance(f.dataType, T.ArrayType):
                yield F.col(at).alias(label)
            else:
                yield F.coalesce(F.col(at).cast("string"), F.lit("")).alias(label)

    return df.select(*leaves(df.schema, "", ""))


# --- workbooks ---
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def parse_workbook(content: bytes) -> Iterator[tuple[str, list[list[str]], list[str]]]:
    """(sheet, rows, notes) of an .xlsx: merged cells filled, dates as serials, filters and frozen panes noted."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in have:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            cells: dict[tuple[int, int], str] = {}
            for number, row in enumerate(root.find("m:sheetData", _NS)):
                at = int(row.get("r", number + 1)) - 1
                for j, c in enumerate(row.findall("m:c", _NS)):
                    place = _place(c.get("r")) if c.get("r") else (at, j)
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    else:
                        text = "" if v is None else v.text or ""
                        if kind == "s" and text:
                            text = shared[int(text)]
                        elif kind == "b":
                            text = "TRUE" if text == "1" else "FALSE"
                    if text:
                        cells[place] = text
            notes = []
            for m in root.iter(f"{{{_NS['m']}}}mergeCell"):
                (r1, c1), (r2, c2) = map(_place, m.get("ref").split(":"))
                if text := cells.get((r1, c1)):
                    cells.update({(r, c): text for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)})
            if root.find("m:autoFilter", _NS) is not None:
                notes.append("has a filter")
            if root.find(".//m:pane", _NS) is not None:
                notes.append("has frozen panes")
            rows, width = max((r for r, _ in cells), default=-1) + 1, max((c for _, c in cells), default=-1) + 1
            yield sheet.get("name"), [[cells.get((r, c), "") for c in range(width)] for r in range(rows)], notes


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            for sheet, grid, _ in parse_workbook(bytes(content)):
                yield pd.DataFrame({"sheet": sheet, "number": range(len(grid)), "cells": grid})


def _old_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xlrd

    shown = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    for pdf in batches:
        for content in pdf["content"]:
            for sheet in xlrd.open_workbook(file_contents=bytes(content)).sheets():
                yield pd.DataFrame({"sheet": sheet.name, "number": range(sheet.nrows), "cells": [list(map(shown, sheet.row_values(i))) for i in range(sheet.nrows)]})


def _needs(module: str, what: str) -> None:
    if importlib.util.find_spec(module) is None:
        raise ValueError(f"{what} need the package {module}, or a reader in plumbline.sources.router.PLUGINS.")


def stack(tables: list[list[list[str]]]) -> tuple[list[str], list[list[str]]]:
    """(names, rows) of the tables of a document that are as wide as the longest of them, whose first row is the header;
    the first row of each goes, short rows are filled up."""
    tables = [t for t in tables if len(t) >= 2]
    if not tables:
        return [], []
    top = max(tables, key=len)
    width = len(top[0])
    rows = [([("" if c is None else str(c)) for c in r] + [""] * width)[:width] for t in tables if len(t[0]) == width for r in t[1:]]
    return sniff.names([str(c or "").strip() for c in top[0]]), rows


def read_pdf(spark: SparkSession, path: str) -> tuple[DataFrame, IngestReport]:
    """The ruled tables of a document, stacked; without any, its lines as column `text`. Needs pdfplumber."""
    _needs("pdfplumber", "PDF tables")
    import pdfplumber

    with pdfplumber.open(io.BytesIO(head(spark, path, 1 << 28))) as pdf:
        pages = list(pdf.pages)
        columns, rows = stack([t for p in pages for t in p.extract_tables() or []])
        if not columns:
            columns, rows = ["text"], [[line] for p in pages for line in (p.extract_text() or "").splitlines() if line.strip()]
    report = IngestReport("pdf", columns=len(columns), notes=[f"{len(pages)} pages"])
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in columns)), report


def read_all_sheets(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, IngestReport]]:
    """Every sheet that has rows, by name and in order; sheets are never merged."""
    old = path.lower().endswith(".xls")
    if old:
        _needs("xlrd", "Old binary .xls workbooks")
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_old_rows if old else _rows, _ROW)
    heads = rows.where(F.col("number") < sniff.ROWS).groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("number", "cells"))).alias("top")).collect()
    order = sorted(r["sheet"] for r in heads) if old else _sheet_order(head(spark, path, 1 << 28))
    out = {}
    for r in sorted(heads, key=lambda r: order.index(r["sheet"])):
        grid = [list(x["cells"]) for x in r["top"]]
        columns, start, above = sniff.layout(grid)
        body = rows.where((F.col("sheet") == r["sheet"]) & (F.col("number") >= start))
        table = body.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(columns)])
        table = table.where(F.greatest(*[F.length(F.trim(F.col(f"`{c}`"))) for c in columns], F.lit(0)) > 0) if columns else table
        report = IngestReport("workbook", sheet=r["sheet"], sheets=order, header_row=start, data_row=start + 1, orientation=sniff.orientation(grid), skipped_rows=above)
        table = drop_empty_columns(table, report)
        report.columns = len(table.columns)
        out[r["sheet"]] = (table, report)
    return out


def _sheet_order(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, IngestReport]:
    """One sheet: the named one, or the fullest, with helper sheets (notes, lookups) held back."""
    sheets = read_all_sheets(spark, path)
    if sheet is not None:
        return sheets[sheet]
    weight = {}
    for name, (df, _) in sheets.items():
        weight[name] = df.count() * len(df.columns) * (HELPER_PENALTY if re.search(HELPER_SHEETS, name) else 1.0)
    return sheets[max(weight, key=weight.get)]


def transpose(df: DataFrame) -> DataFrame:
    """The first column as the header; for small tables with labels down the side."""
    out = df.transpose(df.columns[0])
    return out.drop(out.columns[0])
