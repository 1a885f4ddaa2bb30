"""Writing tables: CSV by Spark; workbooks and documents of bounded size by the driver."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X

SHEET_ROWS, DOCUMENT_ROWS, PREVIEW = 1_048_575, 2000, 90


def store(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of bounded size, written by the driver into any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def export_safe(df: DataFrame) -> DataFrame:
    """Every string column without line breaks and control characters."""
    return df.select(*[X.export_safe(f"`{c}`").alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes])


def to_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV parts, or one part for tables known to be small."""
    out = export_safe(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def sheet_names(names: list[str]) -> list[str]:
    """Valid and different sheet names of 31 characters at most."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", " ", n).strip()[:31] or "Sheet"
        name, k = base, 2
        while name.lower() in (x.lower() for x in out):
            name, k = f"{base[: 31 - len(f'_{k}')]}_{k}", k + 1
        out.append(name)
    return out


def _grid(df: DataFrame, most: int) -> list[list[str]]:
    rows = export_safe(df).limit(most + 1).collect()
    return [[("" if v is None else str(v)) for v in r] for r in rows]


def _column(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def to_xlsx(tables: dict[str, DataFrame] | DataFrame, path: str) -> None:
    """A workbook with one sheet a table; a table beyond a sheet's rows is an error, not cut."""
    tables = tables if isinstance(tables, dict) else {"Sheet1": tables}
    names, parts = sheet_names(list(tables)), {}
    spark = next(iter(tables.values())).sparkSession
    for i, df in enumerate(tables.values(), 1):
        rows = _grid(df, SHEET_ROWS)
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"More than {SHEET_ROWS} rows don't fit a sheet; write CSV.")
        cell = lambda r, c, v: f'<c r="{_column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        lines = [f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row) if v)}</row>' for r, row in enumerate([df.columns, *rows], 1)]
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{kinds}"><sheets>{sheets}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = _relations([(f"rId{i}", f"{kinds}/worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)])
    parts["_rels/.rels"] = _relations([("rId1", f"{kinds}/officeDocument", "xl/workbook.xml")])
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts["[Content_Types].xml"] = _types([("/xl/workbook.xml", f"{main}sheet.main+xml"), *[(f"/xl/worksheets/sheet{i}.xml", f"{main}worksheet+xml") for i in range(1, len(names) + 1)]])
    store(spark, path, _zip(parts))


def _relations(rows: list[tuple[str, str, str]]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{t}" Target="{x}"/>' for i, t, x in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def _types(rows: list[tuple[str, str]]) -> str:
    inner = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in rows)
    return f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{inner}</Types>'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


def to_docx(df: DataFrame, path: str, title: str = "Table", intro: str = "") -> None:
    """A document with a title and a table of the first 2000 rows, and how many more there are."""
    total = df.count()
    rows = _grid(df, DOCUMENT_ROWS)[:DOCUMENT_ROWS]
    para = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    line = lambda cells: f"<w:tr>{''.join(f'<w:tc>{para(c)}</w:tc>' for c in cells)}</w:tr>"
    more = para(f"… and {total - len(rows)} more rows") if total > len(rows) else ""
    body = para(title, "Title") + (para(intro) if intro else "") + f"<w:tbl>{line(df.columns)}{''.join(map(line, rows))}</w:tbl>" + more
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    content = _zip(
        {
            "[Content_Types].xml": _types([("/word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml")]),
            "_rels/.rels": _relations([("rId1", f"{kinds}/officeDocument", "word/document.xml")]),
            "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
        }
    )
    store(df.sparkSession, path, content)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writers = {"csv": to_csv, "xlsx": to_xlsx, "excel": to_xlsx, "docx": to_docx, "word": to_docx}
    if fmt not in writers:
        raise ValueError(f"Unsupported export format: {fmt}")
    writers[fmt](df, path)


def write_artefacts(run, folder: str, stem: str) -> dict[str, str]:
    """The cleaned table and the flagged rows as CSV, and the report as JSON, of a plan's run."""
    paths = {"standardized": f"{folder}/{stem}_STANDARDIZED.csv", "flagged": f"{folder}/{stem}_flagged.csv", "audit": f"{folder}/{stem}_audit.json"}
    to_csv(run.table, paths["standardized"])
    to_csv(run.flagged, paths["flagged"])
    store(run.raw.sparkSession, paths["audit"], json.dumps(run.report(), indent=1, ensure_ascii=False, default=str).encode())
    return paths
