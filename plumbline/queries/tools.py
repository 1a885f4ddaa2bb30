"""Readers and writers, headers, decisions, similarity, and what may leave the machine: queries over whole tables."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import api
from plumbline.functions import kernels as K
from plumbline.functions import text as X
from plumbline.operators import distribution, domains, duplicates, entities, flows, headers, knowledge, names, privacy, review, scoreboard
from plumbline.operators.profile import profile
from plumbline.operators.transforms import list_transforms
from plumbline.plans.plan import run_plan
from plumbline.plans.shared import new_path
from plumbline.queries.registry import query, read
from plumbline.sources import export, files, router, sniff


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], columns: str) -> str:
    """SQL for a fixed list of rows."""
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({columns})"


# --- heads of files ---
#: name: (lines of a file, encoding, delimiter, header row, names)
_HEADS = {
    "plain": ("id,name,amount\n1,Ann,10\n2,Bob,20\n3,Cid,30\n", "utf-8", ",", ["id", "name", "amount"]),
    "banner": ("Report of 2020\n\nid;full name;state\n1;Ann;Lagos\n2;Bob;Kano\n", "utf-8", ";", ["id", "full name", "state"]),
    "stacked": ("Region,Sales,,Staff\n,total,part,total\nNorth,10,2,5\nSouth,20,3,6\nEast,30,4,7\n", "utf-8", ",", ["Region", "Sales - total", "Sales - part", "Staff - total"]),
    "repeats": ("a\t\ta\tb\tc\td\te\t44197\n1\tx\t2\t3\t4\t5\t6\t7\n8\ty\t9\t8\t7\t6\t5\t4\n7\tz\t8\t9\t1\t2\t3\t4\n", "utf-8", "\t", ["a", "column_1_no_header", "a_1", "b", "c", "d", "e", "2021-01-01"]),
    "marked": ("﻿id|name\n1|Ann\n2|Bob\n", "utf-8-sig", "|", ["id", "name"]),
    "wide": ("﻿name,age\nÉva,3\nZoë,4\n", "utf-16", ",", ["name", "age"]),
    "old": ("ville,âge\nÉpinal,3\nNîmes,4\n", "latin-1", ",", ["ville", "âge"]),
}
_CODEC = {"utf-8-sig": "utf-8", "utf-16": "utf-16-le"}


def _head(name: str) -> tuple[bytes, str]:
    text, codec, *_ = _HEADS[name]
    return text.encode(_CODEC.get(codec, codec)), text.removeprefix("﻿")


@query(_values([(n, h[1] if n != "old" else "one byte a letter") for n, h in _HEADS.items()], "name, encoding"))
def sniff_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = {n: sniff.encoding(_head(n)[0]) for n in _HEADS}
    one_byte = {n: c if "utf" in c else "one byte a letter" for n, c in told.items()}  # which of them is open
    return _rows(spark, list(one_byte.items()), "name string, encoding string")


@query(_values([(n, h[2]) for n, h in _HEADS.items()], "name, delimiter"))
def sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(n, sniff.delimiter(_head(n)[1])) for n in _HEADS], "name string, delimiter string")


@query(_values([(n, i, c) for n, h in _HEADS.items() for i, c in enumerate(h[3])], "name, place, header"))
def sniff_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows found below banners, stacked ones composed with labels carried right, repeats and blanks named."""
    grids = {n: [line.split(h[2]) for line in _head(n)[1].splitlines()] for n, h in _HEADS.items()}
    return _rows(spark, [(n, i, c) for n, g in grids.items() for i, c in enumerate(sniff.layout(g)[0])], "name string, place int, header string")


@query(_values([("banner", 3, 2, 2), ("plain", 1, 0, 0), ("repeats", 1, 0, 0), ("stacked", 2, 0, 0)], "name, data_start, band_start, header_row"))
def sniff_data_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of mixed data, the first of the header rows above it, and the best single header row."""
    out = []
    for n in ("plain", "banner", "stacked", "repeats"):
        grid = [line.split(_HEADS[n][2]) for line in _head(n)[1].splitlines()]
        start = sniff.data_start(grid)
        band = sniff.header_band(grid, start) if start else []
        out.append((n, start, band[0] if band else sniff.header_row(grid), sniff.header_row(grid)))
    return _rows(spark, out, "name string, data_start int, band_start int, header_row int")


_SIDEWAYS = [["Name", "A", "B", "C", "D", "E"], ["Age", "1", "2", "3", "4", "5"], ["City", "x", "y", "z", "u", "v"]]
_FORM = [["Name:", ""], ["", ""], ["Phone:", ""], ["", ""], ["Email:", ""]]


@query(_values([("sideways", "transposed"), ("form", "form"), ("table", "normal")], "name, orientation"))
def sniff_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = {"sideways": _SIDEWAYS, "form": _FORM, "table": [["a", "b"], ["1", "2"], ["3", "4"]]}
    return _rows(spark, [(n, sniff.orientation(g)) for n, g in grids.items()], "name string, orientation string")


@query(_values([("A", "1", "x"), ("B", "2", "y"), ("C", "3", "z"), ("D", "4", "u"), ("E", "5", "v")], '"Name", "Age", "City"'))
def read_sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose labels run down its first column."""
    path = f"{new_path(spark, 'sideways')}.csv"
    export.store(spark, path, "\n".join(",".join(r) for r in _SIDEWAYS).encode())
    return router.read_any(spark, path)[0]


@query("SELECT CAST(n_regionkey AS VARCHAR) AS r, n_name AS name FROM nation WHERE n_nationkey = 3")
def transpose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "nation").where("n_nationkey = 3")  # two labels and a column of values
    return files.transpose(one.select(F.inline(F.array(F.struct(F.lit("r").alias("label"), F.col("n_regionkey").cast("string").alias("value")), F.struct(F.lit("name").alias("label"), F.col("n_name").alias("value"))))))


_CUSTOMER_TEXT = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(_CUSTOMER_TEXT)
def read_banner_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A banner, a blank line, semicolons, a byte order mark and an empty column, read without any hint."""
    path = f"{new_path(spark, 'banner')}.csv"
    lines = ["﻿Customers of the year;;;;", ";;;;", "c_custkey;c_name;empty;c_nationkey;c_mktsegment"]
    lines += [f"{r[0]};{r[1]};;{r[2]};{r[3]}" for r in _customers(spark, sf_dir).toLocalIterator()]
    export.store(spark, path, "\n".join(lines).encode())
    return router.read_any(spark, path)[0]


@query(_CUSTOMER_TEXT)
def read_wide_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_path(spark, 'wide')}.tsv"
    lines = ["c_custkey\tc_name\tc_nationkey\tc_mktsegment"] + ["\t".join(map(str, r)) for r in _customers(spark, sf_dir).toLocalIterator()]
    export.store(spark, path, "\n".join(lines).encode("utf-16"))
    return router.read_any(spark, path)[0]


@query(_CUSTOMER_TEXT)
def read_plain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_path(spark, 'plain')}.csv"
    _customers(spark, sf_dir).write.option("header", "true").csv(path)
    return router.read_table(spark, path)


@query(_CUSTOMER_TEXT)
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest sheet of a workbook of three, one of them a helper's."""
    path = f"{new_path(spark, 'book')}.xlsx"
    export.export({"nations": read(spark, sf_dir, "nation"), "customers": _customers(spark, sf_dir), "lookup": read(spark, sf_dir, "region")}, path, "xlsx")
    return router.read_any(spark, path)[0]


@query("SELECT 'nations' AS sheet, count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'regions', count(*), 2 FROM region UNION ALL SELECT 'suppliers', count(*), 2 FROM supplier")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_path(spark, 'sheets')}.xlsx"
    export.to_xlsx({"nations": read(spark, sf_dir, "nation"), "regions": read(spark, sf_dir, "region"), "suppliers": read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")}, path)
    sheets = files.read_all_sheets(spark, path)
    return _rows(spark, [(name, df.count(), report.columns) for name, (df, report) in sheets.items()], "sheet string, rows long, columns int")


@query(_values([("North", "a", "1"), ("North", "b", "2"), ("South", "c", "3")], '"region", "name", "amount"'))
def workbook_merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label merged over two rows stands in both."""
    path = f"{new_path(spark, 'merged')}.xlsx"
    export.to_xlsx(_rows(spark, [("North", "a", "1"), ("", "b", "2"), ("South", "c", "3")], "region string, name string, amount string").coalesce(1), path)
    old, new = io.BytesIO(files.head(spark, path, 1 << 28)), io.BytesIO()
    with zipfile.ZipFile(old) as a, zipfile.ZipFile(new, "w") as b:
        for item in a.namelist():
            b.writestr(item, a.read(item).replace(b"</sheetData>", b'</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells>'))
    export.store(spark, path, new.getvalue())
    return files.read_excel(spark, path)[0]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def document_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a written document, read from its markup."""
    path = f"{new_path(spark, 'document')}.docx"
    export.export(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, "docx")
    tag = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(files.head(spark, path, 1 << 28))) as z:
        table = ElementTree.fromstring(z.read("word/document.xml")).find(f".//{tag}tbl")
    grid = [["".join(t.text or "" for t in cell.iter(f"{tag}t")) for cell in row.iter(f"{tag}tc")] for row in table.iter(f"{tag}tr")]
    return _rows(spark, [tuple(r) for r in grid[1:]], ", ".join(f"{c} string" for c in grid[0]))


_PLAN = {"name": "people", "mappings": [{"source_column": "c_name", "target_field": "name", "transform": "upper"}, {"source_column": "c_mktsegment", "target_field": "segment", "transform": "name"}]}
_CLEANED = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, upper(c_name) AS name, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment FROM customer"


@query(_CLEANED)
def clean_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file cleaned by a plan, its artefacts written, and the cleaned table read back."""
    stem = new_path(spark, "clean")
    read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.lower("c_name")).alias("c_name"), "c_mktsegment").write.option("header", "true").csv(f"{stem}.csv")
    run = run_plan(router.read_table(spark, f"{stem}.csv"), _PLAN)
    paths = export.write_artefacts(run, stem, "customers")
    return router.read_table(spark, paths["standardized"]).select("c_custkey", "name", "segment")


@query("SELECT 'name' AS field, count(*) FILTER (c_name <> upper(c_name)) AS changed, 0 AS flagged FROM customer UNION ALL SELECT 'segment', count(*) FILTER (c_mktsegment <> upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))), 0 FROM customer")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of a run says, read from its file."""
    stem = new_path(spark, "audit")
    paths = export.write_artefacts(run_plan(read(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), _PLAN), stem, "customers")
    report = json.loads(files.head(spark, paths["audit"]))
    return _rows(spark, [(f["target_field"], f["changed"], f["flagged"]) for f in report["columns"]], "field string, changed long, flagged long")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"Key\", c_mktsegment AS \"Segment\" FROM customer")
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_path(spark, 'rename')}.csv"
    read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.option("header", "true").csv(path)
    session = api.clean(spark, path, rename={"c_custkey": "Key", "c_mktsegment": "Segment"}, plan={"mappings": []}, similar=False)
    return session.table.select("Key", "Segment")


@query("SELECT least(count(*), 50) AS n FROM customer")
def preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_path(spark, 'preview')}.csv"
    read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.option("header", "true").csv(path)
    return _rows(spark, [(len(api.profile_file(spark, path)["preview"]),)], "n long")


# --- headers ---
_TABLES = ("customer", "supplier", "part", "orders", "lineitem")


def _headers(spark: SparkSession, sf_dir: str) -> list[str]:
    return [c for t in _TABLES for c in read(spark, sf_dir, t).columns]


_ALL_HEADERS = " UNION ALL ".join(f"SELECT column_name AS header FROM (DESCRIBE {t})" for t in _TABLES)


@query(f"SELECT header, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS key FROM ({_ALL_HEADERS})")
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(h, X.header_key(h)) for h in _headers(spark, sf_dir)], "header string, key string")


@query(f"SELECT header, regexp_matches(lower(header), '(name|surname|first|last|phone|msisdn|email|\\bnin\\b|bvn|passport|account|acct|address|\\bdob\\b|birth|patient|client.?id)') AS sensitive FROM ({_ALL_HEADERS})")
def sensitive_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(h, privacy.looks_sensitive(h)) for h in _headers(spark, sf_dir)], "header string, sensitive boolean")


@query(_values([("c_custkey", "C Custkey"), ("c_name", "C Name"), ("c_nationkey", "C Nationkey"), ("c_acctbal", "C Acctbal"), ("c_mktsegment", "C Mktsegment")], '"column", proposed'))
def propose_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(h["column"], h["proposed"]) for h in headers.propose_headers(profile(read(spark, sf_dir, "customer")))], "column string, proposed string")


@query(_values([("Amount", "Amount", False), ("amount.1", "Amount", False), ("State", "State", False), ("Facility", "Facility", True)], "header, kept, alone"))
def duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["Amount", "State", "amount.1", "Facility"]
    group = {c: g for g in duplicates.duplicate_columns([*heads, "STATE."]) for c in g}
    return _rows(spark, [(c, group.get(c, [c])[0], c not in group) for c in heads], "header string, kept string, alone boolean")


@query(
    """
    SELECT 'o_custkey, copy' AS columns, 'copy' AS keep, round(count(*) FILTER (o_orderkey % 9 <> 0) / CAST(count(*) AS DOUBLE), 2) AS overlap FROM orders
    """
)
def duplicate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns that agree in eight rows of nine are one field; the one of the shorter name stays."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("copy"), "o_orderpriority")
    return _rows(spark, [(", ".join(g["columns"]), g["keep"], g["overlap"]) for g in duplicates.duplicate_fields(df)], "columns string, keep string, overlap double")


@query(
    _values([("NIN", "NIN", "identifier"), ("Sex", "Gender", "gender"), ("Email", "Email", "email"), ("State of Origin", "State", "geo"), ("dob", "Date of Birth", "date")], '"column", name, type')
)
def predict_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    df = read(spark, sf_dir, "customer").select(
        (F.lit(10_000_000_000) + n).cast("string").alias("NIN"),
        F.element_at(F.array(*map(F.lit, ("M", "F", "1", "2"))), (n % 4 + 1).cast("int")).alias("Sex"),
        F.concat(F.lit("u"), n.cast("string"), F.lit("@x.com")).alias("Email"),
        F.element_at(F.array(*map(F.lit, ("Lagos", "Kano", "Ibadan", "Uyo"))), (n % 4 + 1).cast("int")).alias("State of Origin"),
        F.date_format(F.date_add(F.lit("1990-01-13").cast("date"), (n % 900).cast("int")), "dd/MM/yyyy").alias("dob"),
    )
    said = knowledge.Corrections([knowledge.Entry("state", "ibadan", ("OYO",)), knowledge.Entry("state", "uyo", ("AKWA IBOM",))])
    return _rows(spark, [(f["column"], f["name"], f["type"]) for f in headers.predict_file(df, said)], "column string, name string, type string")


# --- texts of cells ---
@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name || ' ' || c_acctbal, '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g') AS masked FROM customer")
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", X.mask(F.concat_ws(" ", "c_name", F.col("c_acctbal").cast("string"))).alias("masked"))


@query(
    """
    SELECT "column", shape, count(*) AS n FROM (
      SELECT 'key' AS "column", '[' || length(CAST(c_custkey AS VARCHAR)) || ' digits]' AS shape FROM customer
      UNION ALL SELECT 'segment', '[' || length(c_mktsegment) || ' letters]' FROM customer
      UNION ALL SELECT 'balance', '[number]' FROM customer
      UNION ALL SELECT 'name', '[mixed]' FROM customer)
    GROUP BY ALL
    """
)
def shape_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("balance"), F.col("c_name").alias("name"))
    each = F.array(*[F.struct(F.lit(n).alias("column"), X.shape(n).alias("shape")) for n in c.columns])
    return c.select(F.inline(each)).groupBy("column", "shape").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber || ',' || CAST(l_quantity AS BIGINT) AS numbers FROM lineitem")
def numbers_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("line 0"), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_quantity").cast("long").cast("string"), F.lit(" pcs"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(X.numbers_in(raw), ",").alias("numbers"))


@query("SELECT DISTINCT text AS value, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM documents WHERE lang IN ('fr', 'es') AND regexp_full_match(text, '[\\x00-\\x7EÀ-ÿ]*')")
def resolver_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of accented letters as the resolver compares them."""

    def kernel(batches):
        for pdf in batches:
            yield pdf.assign(key=[K.normalize(v) for v in pdf["value"]])

    texts = read(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "es") & F.col("text").rlike("^[\\x00-\\x7EÀ-ÿ]*$")).select(F.col("text").alias("value")).distinct()
    return texts.mapInPandas(kernel, "value string, key string")


@query("SELECT a.p_name AS a, b.p_name AS b, round(jaro_similarity(a.p_name, b.p_name), 6) AS jaro FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name")
def jaro_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "jaro", K.jaro)


@query(
    """
    WITH v AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b FROM v a JOIN v b ON a.p_name < b.p_name),
    c AS (SELECT a, b, list_sort(string_split(a, ' ')) AS x, list_sort(string_split(b, ' ')) AS y FROM p)
    SELECT a, b, CASE WHEN len(list_intersect(x, y)) = 0 THEN 'apart' WHEN len(list_intersect(x, y)) = least(len(list_distinct(x)), len(list_distinct(y))) THEN 'inside' ELSE 'some' END AS words FROM c
    """
)
def token_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token-set ratio is 100 just where one value's words are all in the other."""
    pairs = _pairs(spark, sf_dir, "ratio", K.token_set_ratio)
    shared = F.size(F.array_intersect(F.split("a", " "), F.split("b", " ")))
    return pairs.select("a", "b", F.when(F.col("ratio") >= 100, "inside").when(shared > 0, "some").otherwise("apart").alias("words"))


def _pairs(spark: SparkSession, sf_dir: str, name: str, score) -> DataFrame:
    """A score of all pairs of the part names, of which there are 64 at any size."""
    v = read(spark, sf_dir, "part").select("p_name").distinct()

    def kernel(batches):
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], name: [round(float(score(a, b)), 6) for a, b in zip(pdf["a"], pdf["b"], strict=True)]})

    names_of = v.agg(F.collect_set("p_name").alias("all"))
    pairs = v.select(F.col("p_name").alias("a")).join(F.broadcast(names_of)).select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.mapInPandas(kernel, f"a string, b string, {name} double")


@query(_values([("knight", "NT", "KNGHT"), ("byrne", "BRN", "BYRN"), ("phone", "FN", "PHN"), ("school", "SKL", "SCHL"), ("wright", "RT", "WRGHT")], "word, metaphone, match_rating"))
def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(w, K.metaphone(w).upper(), K.match_rating_codex(w)) for w in ("knight", "byrne", "phone", "school", "wright")], "word string, metaphone string, match_rating string")


# --- decisions ---
@query("SELECT c_custkey, c_name, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment FROM customer")
def reject_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejected column keeps what it had; the others are cleaned."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return review.apply_decisions(df, _PLAN, review.Decisions(reject=["name"]))[0]


@query("SELECT DISTINCT p_name, p_type FROM part")
def drop_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_decisions(read(spark, sf_dir, "part").select("p_name", "p_type"), {"mappings": []}, review.Decisions(remove_duplicates=True))[0]


@query("SELECT 'set all' AS action, count(*) FILTER (p_type <> 'PROMO') AS changed FROM part")
def set_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, audit = review.apply_decisions(read(spark, sf_dir, "part").select("p_partkey", "p_type"), {"mappings": []}, review.Decisions(set_all={"p_type": "PROMO"}))
    return _rows(spark, [(a["action"], a["changed"]) for a in audit], "action string, changed long")


@query(_values([("accepted", 1), ("proposed", 1), ("rejected", 1), ("safe", 2)], "status, n"))
def decision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = review.Ledger()
    ledger.accept(ledger.propose("merge", "state"))
    ledger.reject(ledger.propose("drop", "x"))
    ledger.propose("merge", "lga")
    for c in ("a", "b"):
        ledger.note_safe("trim", c)
    assert ledger.summary()["needs_approval"] == 1
    return ledger.table(spark).groupBy("status").agg(F.count("*").alias("n"))


# --- what may leave the machine ---
@query("SELECT p_name AS value FROM (SELECT DISTINCT p_name FROM part ORDER BY 1 LIMIT 12)")
def sample_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(v,) for v in privacy.sample_distinct(read(spark, sf_dir, "part"), "p_name")], "value string")


@query("SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g') AS value, 'masked' AS mode FROM (SELECT DISTINCT c_name FROM customer ORDER BY 1 LIMIT 12)")
def column_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensitive column is masked by default."""
    asked = privacy.build_column_query(read(spark, sf_dir, "customer"), "c_name")
    return _rows(spark, [(v, asked["mode"]) for v in asked["values"]], "value string, mode string")


# --- names, domains, places ---
@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS estimate FROM nation")
def name_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(F.array(*map(F.lit, ("Aisha Bello", "musa ", "Sam Obi", "Unheard Of"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    df = read(spark, sf_dir, "nation").select("n_nationkey", first.alias("Full name"))
    table = _rows(spark, [("aisha", "F", 0.98), ("musa", "M", 0.99), ("sam", "M", 0.6)], "name string, gender string, share double")
    out, said = names.guess_gender(df, table)
    return out.select("n_nationkey", F.col(f"{said['column']}_gender_estimate").alias("estimate"))


@query(_values([("Sex", "sex"), ("Currency", "currency"), ("Nationality", "country"), ("In what LGA?", "lga"), ("Remark", None)], "header, domain"))
def detect_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of columns made of few values, some of them unknown."""
    made = {"Sex": ("male", "F", "woman"), "Currency": ("NGN", "US Dollar", "zzz"), "Nationality": ("Ghana", "NGA", "Atlantis"), "In what LGA?": ("Zaria", "Igabi", "xyz"), "Remark": ("good", "bad", "none at all")}
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % 3 + 1).cast("int"))
    df = read(spark, sf_dir, "customer").select(*[pick(v).alias(h) for h, v in made.items()])
    d = domains.Domains(spark=spark)
    return _rows(spark, [(h, d.detect_column(df, h)) for h in made], "header string, domain string")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'NGN' WHEN 1 THEN 'EUR' END AS v_canonical FROM nation")
def currency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 3 == 0, " ngn").when(F.col("n_nationkey") % 3 == 1, "Euro").otherwise("beads")
    df = read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("v"))
    return domains.Domains(spark=spark).resolved(df, "v", "currency").drop("v")


@query("SELECT round(count(DISTINCT n_name) FILTER (n_nationkey % 3 = 0) / CAST(count(DISTINCT n_name) AS DOUBLE), 6) AS share FROM nation")
def looks_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of distinct values that name a state: every third is spelled as one, with a suffix that keeps it distinct."""
    place = F.concat(F.lit("Kano / "), F.col("n_name"))
    df = read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, place).otherwise(F.col("n_name")).alias("v"))
    return _rows(spark, [(round(domains.Domains().looks_like(df, "v", "state"), 6),)], "share double")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'conflict' END AS known_kind, CASE c_custkey % 3 WHEN 0 THEN 'OYO' END AS known_canonical FROM customer")
def corrections_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections appended to a log in the shared folder by one job, and resolved by another."""
    path = new_path(spark, "corrections")
    said = knowledge.Corrections()
    said.say("state", "Ibadan", "LAGOS")
    said.say("state", "Abuja(Jos)", "FCT", "PLATEAU")
    said.log(spark).write.json(path)
    _rows(spark, [(9, "state", "ibadan", ["OYO"])], knowledge.SCHEMA).write.mode("append").json(path)
    raw = F.when(F.col("c_custkey") % 3 == 0, " IBADAN").when(F.col("c_custkey") % 3 == 1, "abuja (jos)").otherwise("else")
    df = read(spark, sf_dir, "customer").select("c_custkey", raw.alias("v"))
    return knowledge.known(df, "v", "state", spark.read.schema(knowledge.SCHEMA).json(path)).select("c_custkey", "known_kind", "known_canonical")


@query(_values([("pref", "geo"), ("other", "categorical")], '"column", kind'))
def region_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a region of one's own: its prefectures are places, the default region's states aren't."""
    folder = new_path(spark, "region")
    export.store(spark, f"{folder}/states.json", json.dumps({"states": ["Hokkaido", "Aomori", "Iwate", "Akita"]}).encode())
    export.store(spark, f"{folder}/places.json", json.dumps({"places": {"sapporo": "Hokkaido"}}).encode())
    region = api.Region("JP", "Japan", "JP", "YMD", states_ref=f"{folder}/states.json", places_ref=f"{folder}/places.json")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    df = read(spark, sf_dir, "customer").select(pick(("Hokkaido", "aomori", "Iwate", "Sapporo")).alias("pref"), pick(("round", "square", "flat", "long")).alias("other"))
    return _rows(spark, [(p.column, p.semantic_type) for p in profile(df, **api.load_reference(spark, region))], "column string, kind string")


# --- what there is ---
@query(_values([("c_custkey", "identifier"), ("c_name", "identifier"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")], '"column", kind'))
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")
    return _rows(spark, list(distribution.kinds(df).items()), "column string, kind string")


@query(_values([("outliers", 4), ("match", 3), ("anything else", 1)], "tool, steps"))
def tool_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t, len(flows.flow(t))) for t in ("outliers", "match", "anything else")], "tool string, steps int")


_TRANSFORMS = "auto_categorical boolean date_iso datetime_iso email fixed_id gender latitude lga_ng longitude name nin numeric phone phone_ng range_check resolve sentinel_na state_ng text_clean text_normalise unit_numeric upper".split()


@query(_values([(t,) for t in _TRANSFORMS], "transform"))
def transforms_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(t,) for t in list_transforms() if t in _TRANSFORMS], "transform string")


@query("SELECT 'geo' AS type, round(count(*) FILTER (n_nationkey % 5 > 0) / CAST(count(*) AS DOUBLE), 6) AS share FROM nation")
def entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger that knows a nation by its prefix; one value in five holds other words for the most part."""
    tagger = lambda texts: [("GPE", 8) if t.startswith("NATION_") else None for t in texts]
    df = read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit(" and many other words"))).otherwise(F.col("n_name")).alias("v"))
    kind, share = entities.entity_type(df, "v", tagger)
    return _rows(spark, [(kind, round(share, 6))], "type string, share double")


@query(_values([("areas", 4, 4, 1.0, "good"), ("countries", 6, 4, 1.0, "good"), ("text similarity", 4, 4, 0.75, "ok")], "name, n, answered, accuracy, band"))
def understanding_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, places = domains.Domains(), domains.Places()
    groups = [
        scoreboard.Group("countries", [("Nigeria", "Nigeria"), ("naija", "Nigeria"), ("NGA", "Nigeria"), ("ghana.", "Ghana"), ("Female", None), ("good morning", None)], lambda v: d.canonical("country", v)),
        scoreboard.Group("areas", [("Zaria", "lga"), ("Zaria LGA", "lga"), ("Kano", "is_state"), ("Somewhere", "unknown")], lambda v: places.check(v, "lga")["kind"]),
        scoreboard.Group("text similarity", [(("maize", "Maize"), True), (("Sorghum", "Sorgum"), True), (("Niger", "Rice"), False), (("Groceries", "Provisions"), True)], lambda p: K.similarity(*p) >= 0.72),
    ]
    return scoreboard.scoreboard(spark, groups).select("name", "n", "answered", "accuracy", "band")


@query(_values([("1", "Ann"), ("2", "Bob"), ("3", ""), ("4", "Dan")], "id, column_1_no_header"))
def stack_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a document under each other: those as wide as the longest, without their header rows."""
    columns, rows = files.stack([[["id", None], ["1", "Ann"], ["2", "Bob"], ["3"]], [["a", "b", "c"], ["x", "y", "z"]], [["id", "name"], ["4", "Dan"]], [["alone"]]])
    return _rows(spark, [tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns))
