"""Any file as a table of text, by its extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import files
from plumbline.sources.sniff import IngestReport

#: Readers that others add: extension to (spark, path) -> (table, report).
PLUGINS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, IngestReport]]] = {}


def read_any(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, IngestReport]:
    """(table, report) of csv, tsv, tab, txt, xlsx, xlsm, json, ndjson, jsonl, parquet or orc, compressed or not."""
    name = path.lower().removesuffix(".gz").removesuffix(".bz2")
    kind = name.rsplit(".", 1)[-1] if "." in name.rsplit("/", 1)[-1] else ""
    if kind in PLUGINS:
        return PLUGINS[kind](spark, path)
    if kind in ("csv", "tsv", "tab", "txt"):
        return files.read_csv_like(spark, path)
    if kind in ("xlsx", "xlsm", "xls"):
        return files.read_excel(spark, path, sheet)
    if kind in ("json", "ndjson", "jsonl"):
        return files.read_json(spark, path)
    if kind in ("parquet", "orc"):
        df = spark.read.format(kind).load(path)
        return df, IngestReport(kind, columns=len(df.columns))
    if kind == "pdf":
        return files.read_pdf(spark, path)
    raise ValueError(f"Unsupported file type: {path}")


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A plain file with one header row, every column text, '' for missing: what plans read."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        return files.read_excel(spark, path)[0]
    sep = sep or ("\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    df = spark.read.options(header="true", sep=sep, inferSchema="false", quote='"', escape='"', nullValue="\x00", emptyValue="").csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
