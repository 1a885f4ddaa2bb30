"""Column operators: value transforms, text, dates, numbers, coordinates, reshaping.

The tables are clean, so each query first writes a column the way people do, in the same way in
Spark and in SQL, and then reads it with the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import language, reshape
from plumbline.functions import text as X
from plumbline.functions.reference import STATE_NAMES
from plumbline.operators import embeddings
from plumbline.plans.plan import run_plan, staged
from plumbline.queries.registry import query, read


def transformed(df: DataFrame, source: str, transform: str, target: str = "value", **params) -> DataFrame:
    """`df` with target, flagged and reason of one transform in place of the source column."""
    run = run_plan(df, {"mappings": [{"source_column": source, "target_field": target, "transform": transform, "params": params}]})
    return run.staged.select(*[f"`{c}`" for c in df.columns if c != source], F.col("_t0.value").alias(target), F.col("_t0.flagged").alias("flagged"), F.col("_t0.reason").alias("reason"))


def case(key: Column, n: int, *ways: Column) -> Column:
    """ways[key % n]; the last for all others."""
    out = ways[-1]
    for i in range(len(ways) - 2, -1, -1):
        out = F.when(key % n == i, ways[i]).otherwise(out)
    return out


CUSTOMER_PLAN = {
    "name": "customer",
    "mappings": [
        {"source_column": "raw_name", "target_field": "name", "transform": "name", "params": {}},
        {"source_column": "number", "target_field": "cust_no", "transform": "fixed_id", "params": {"length": 9}},
        {"source_column": "c_acctbal", "target_field": "balance", "transform": "range_check", "params": {"min": 0}},
    ],
}


def customer_run(spark: SparkSession, sf_dir: str):
    raw = read(spark, sf_dir, "customer").withColumns({"raw_name": F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")), "number": F.col("c_name")}).drop("c_name")
    return run_plan(raw, CUSTOMER_PLAN)


_CUSTOMER = """
    SELECT upper(substr(s, 1, 1)) || lower(substr(s, 2)) AS name, regexp_replace(c_name, '[^0-9]', '', 'g') AS cust_no,
           CAST(c_acctbal AS VARCHAR) AS balance, c_custkey, c_nationkey, c_mktsegment, c_acctbal, s, c_name,
           c_acctbal < 0 AS low, length(regexp_replace(c_name, '[^0-9]', '', 'g')) <> 9 AS off
    FROM (SELECT *, trim('  ' || upper(c_name) || ' ') AS s FROM customer)
"""


@query(f"SELECT name, cust_no, balance, c_custkey, c_nationkey, c_mktsegment, (low OR off) AS flagged FROM ({_CUSTOMER})")
def plan_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_run(spark, sf_dir).table


@query(
    f"""
    SELECT 'name' AS target_field, 'raw_name' AS source_column, 'name' AS transform, count(*) AS rows, CAST(sum(CASE WHEN name <> '  ' || upper(c_name) || ' ' THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(0 AS BIGINT) AS flagged FROM ({_CUSTOMER})
    UNION ALL SELECT 'cust_no', 'number', 'fixed_id', count(*), CAST(sum(CASE WHEN cust_no <> c_name THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN off THEN 1 ELSE 0 END) AS BIGINT) FROM ({_CUSTOMER})
    UNION ALL SELECT 'balance', 'c_acctbal', 'range_check', count(*), CAST(0 AS BIGINT), CAST(sum(CASE WHEN low THEN 1 ELSE 0 END) AS BIGINT) FROM ({_CUSTOMER})
    """
)
def plan_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_run(spark, sf_dir).counts()


@query(f"SELECT name, cust_no, balance, c_custkey, c_nationkey, c_mktsegment, 'balance: below minimum 0' AS reasons FROM ({_CUSTOMER}) WHERE low")
def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_run(spark, sf_dir).flagged


_NUM = "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END"


@query(
    f"""
    SELECT p_partkey, CASE WHEN k = 4 THEN 'n/a' WHEN k = 1 THEN '-' || {_NUM} ELSE {_NUM} END AS value, k = 4 AS flagged,
           CASE k WHEN 4 THEN 'not numeric (no digits)' WHEN 3 THEN 'read as percent value' ELSE '' END AS reason
    FROM (SELECT p_partkey, p_partkey % 5 AS k, p_retailprice AS x FROM part)
    """
)
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_retailprice").cast("string")
    raw = case(F.col("p_partkey"), 5, F.concat(F.lit(" ₦"), x), F.concat(F.lit("("), x, F.lit(")")), F.replace(x, F.lit("."), F.lit(",")), F.concat(x, F.lit(" %")), F.lit("n/a"))
    return transformed(read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw", "numeric")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, {_NUM} AS value, false AS flagged, '' AS reason FROM (SELECT *, l_extendedprice AS x FROM lineitem)")
def numeric_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return transformed(line.select("l_orderkey", "l_linenumber", "l_quantity", F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("raw")), "raw", "numeric")


@query(f"SELECT p_partkey, {_NUM} AS value, false AS flagged, '' AS reason FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def numeric_decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    european = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    return transformed(read(spark, sf_dir, "part").select("p_partkey", european.alias("raw")), "raw", "numeric", decimal="comma")


@query(
    """
    SELECT l_returnflag, CASE WHEN l_quantity < 5 THEN 'below minimum 5' WHEN l_quantity > 40 THEN 'above maximum 40' ELSE '' END AS reason, count(*) AS n
    FROM lineitem GROUP BY ALL
    """
)
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", "range_check", min=5, max=40)
    return out.groupBy("l_returnflag", "reason").agg(F.count("*").alias("n"))


@query(
    """
    SELECT o_orderkey, CASE k WHEN 0 THEN '' WHEN 1 THEN '' ELSE o_orderstatus END AS value, k < 2 AS flagged,
           CASE k WHEN 0 THEN 'refusal/DK sentinel code (''999'')' WHEN 1 THEN 'refusal/DK sentinel code (''Don''t know'')' ELSE '' END AS reason
    FROM (SELECT *, o_orderkey % 7 AS k FROM orders)
    """
)
def sentinel_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = case(F.col("o_orderkey"), 7, F.lit(" 999"), F.lit("Don't know"), F.col("o_orderstatus"))
    return transformed(read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw", "sentinel_na")


@query(
    """
    SELECT p_partkey, CASE k WHEN 2 THEN 'banana' ELSE CAST(p_size AS VARCHAR) END AS value, k = 2 AS flagged,
           CASE k WHEN 0 THEN 'unit ''kg'' removed' WHEN 2 THEN 'no number found' ELSE '' END AS reason
    FROM (SELECT *, p_partkey % 3 AS k FROM part)
    """
)
def unit_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = case(F.col("p_partkey"), 3, F.concat(size, F.lit(" kg")), size, F.lit("banana"))
    return transformed(read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), "raw", "unit_numeric")


@query("SELECT p_partkey, CAST(round(p_size / 1000.0, 4) AS DOUBLE) AS kg, false AS flagged FROM part")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("g")).alias("raw")), "raw", "unit_numeric", to="kg")
    return out.select("p_partkey", F.col("value").cast("double").alias("kg"), "flagged")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'No' WHEN 'O' THEN 'Yes' ELSE 'P?' END AS value, o_orderstatus NOT IN ('F', 'O') AS flagged FROM orders")
def boolean_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", " FALSE ").when(F.col("o_orderstatus") == "O", "y").otherwise("P?")
    return transformed(read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw", "boolean").drop("reason")


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'other' END AS value, user_id % 3 = 2 AS flagged FROM events")
def gender_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = case(F.col("user_id"), 3, F.lit("Male "), F.lit("GIRL"), F.lit("other"))
    return transformed(read(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "gender").drop("reason")


@query("SELECT c_custkey, upper(c_mktsegment) || ' X' AS value FROM customer")
def upper_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ​"), F.lower("c_mktsegment"), F.lit(" \t x "))
    return transformed(read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw", "upper").select("c_custkey", "value")


@query(
    """
    SELECT c_custkey, d AS value, length(d) <> 11 AS flagged, CASE WHEN length(d) <> 11 THEN 'NIN is ' || length(d) || ' digits, expected 11' ELSE '' END AS reason
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '9') ELSE lpad(CAST(c_custkey AS VARCHAR), 11, '1') END AS d FROM customer)
    """
)
def nin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    digits = F.when(F.col("c_custkey") % 10 == 0, F.lpad(key, 7, "9")).otherwise(F.lpad(key, 11, "1"))
    return transformed(read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.substr(digits, F.lit(1), F.lit(3)), F.lit("-"), F.substr(digits, F.lit(4)), F.lit(".0")).alias("raw")), "raw", "nin")


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN '2021-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, o_orderkey % 6 = 5 AS flagged, CASE o_orderkey % 6 WHEN 5 THEN 'impossible date (month/day out of range)' ELSE '' END AS reason FROM orders")
def date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda f: F.date_format("o_orderdate", f)
    serial = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30"))).cast("string")
    raw = case(F.col("o_orderkey"), 6, day("d/M/yyyy"), day("yyyy-MM-dd"), F.concat(serial, F.lit(".5")), day("d MMM yyyy"), day("dd.MM.yy"), F.lit("2021-13-01"))
    return transformed(read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw", "date_iso", dayfirst=True)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS value, false AS flagged FROM events")
def datetime_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = lambda f: F.date_format("ts", f)
    raw = case(F.col("event_id"), 3, time("yyyy-MM-dd'T'HH:mm:ss"), time("M/d/yyyy HH:mm:ss"), time("yyyy-MM-dd h:mm:ss a"))
    return transformed(read(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "datetime_iso", date_order="MDY").drop("reason")


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) AS serial, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def excel_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30"))).cast("string")
    out = read(spark, sf_dir, "orders").select("o_orderkey", serial.alias("serial"))
    run = run_plan(out.withColumn("s", F.col("serial")), {"mappings": [{"source_column": "s", "target_field": "day", "transform": "date_iso", "params": {}}]})
    return run.table.select("o_orderkey", "serial", "day")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders")
def date_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("d"))
    return staged(df, lambda let: {p: reshape.date_part("d", p, let=let) for p in ("year", "month")}).drop("d")


@query(
    """
    SELECT c_custkey, CASE k WHEN 4 THEN '12345' ELSE '+234803' || n END AS value, k = 4 AS flagged, CASE k WHEN 4 THEN 'not a valid phone number' ELSE '' END AS reason
    FROM (SELECT c_custkey, c_custkey % 5 AS k, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS n FROM customer)
    """
)
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    raw = case(F.col("c_custkey"), 5, F.concat(F.lit("0803"), n), F.concat(F.lit("+234 803-"), n), F.concat(F.lit("234803"), n), F.concat(F.lit("(0803) "), n), F.lit("12345"))
    return transformed(read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw", "phone_ng")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'user' || c_custkey || '@example.com' WHEN 1 THEN 'bad' || c_custkey ELSE 'a..b@c.de' END AS value, c_custkey % 3 <> 0 AS flagged FROM customer")
def email_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    raw = case(F.col("c_custkey"), 3, F.concat(F.lit(" User"), key, F.lit("@Example.com ")), F.concat(F.lit("bad"), key), F.lit("a..b@c.de"))
    return transformed(read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw", "email").drop("reason")


def _extracted(kind: str, pattern: str, tail: str = "''"):
    """`tail`: SQL of what each text is followed by, where the texts themselves hold nothing of the kind."""
    sql = f"SELECT doc_id, array_to_string(list_distinct_sorted, '|') AS found FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text || {tail}, '{pattern}'))) AS list_distinct_sorted FROM documents) WHERE len(list_distinct_sorted) > 0"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat(F.col("text"), F.expr(tail))
        found = read(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.extract(text, kind)).alias("f")).where(F.size("f") > 0)
        return found.select("doc_id", F.array_join("f", "|").alias("found"))

    run.__name__ = f"extract_{kind}"
    return query(sql)(run)


_extracted("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_extracted("phone", r"(?:\+?234|0)\d[\d\s\-]{7,}\d")
_extracted("date", r"\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b")
_extracted("longnum", r"\b\d{10,11}\b", "' ref ' || CAST(doc_id + 10000000000 AS STRING) || ', ' || CAST(doc_id + 123456789 AS STRING)")


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) AS value FROM (SELECT conv_id, turn, replace(replace(text, chr(8217), ''''), chr(8212), '-') AS text FROM conversations)")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("​ "), F.regexp_replace("text", " ", "  "))
    return transformed(read(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")), "raw", "text_clean").select("conv_id", "turn", "value")


@query("SELECT c_custkey, 'école ' || c_custkey AS value FROM customer")
def text_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ã©cole "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("école  "), F.col("c_custkey").cast("string")))
    return transformed(read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw", "text_normalise").select("c_custkey", "value")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN o_orderpriority ELSE '' END AS value FROM orders")
def text_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = case(F.col("o_orderkey"), 4, F.lit("N/A"), F.lit(" unknown "), F.lit("--"), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.blank_missing(X.normalize_text(raw)).alias("value"))


@query("SELECT doc_id, md5(regexp_replace(replace(replace(text, chr(13), ''), chr(10), ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) AS safe_md5 FROM documents")
def export_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.export_safe("text").cast("binary")).alias("safe_md5"))


_STATES = "[" + ", ".join(f"'{s}'" for s in STATE_NAMES) + "]"


@query(
    f"""
    SELECT n_nationkey, CASE k WHEN 3 THEN 'Atlantis' WHEN 4 THEN '' ELSE s END AS value, k >= 3 AS flagged,
           CASE k WHEN 3 THEN 'state not recognised: ''Atlantis''' WHEN 4 THEN 'no usable state (blank or sentinel)' ELSE '' END AS reason
    FROM (SELECT n_nationkey, n_nationkey % 5 AS k, ({_STATES})[n_nationkey + 1] AS s FROM nation)
    """
)
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, STATE_NAMES)), F.col("n_nationkey") + 1)
    raw = case(F.col("n_nationkey"), 5, s, F.concat(F.lower(s), F.lit(" (old)")), F.concat(F.lit(" "), s), F.lit("Atlantis"), F.lit("Unknown"))
    return transformed(read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw")), "raw", "state_ng")


@query(
    """
    SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Zaria' WHEN 1 THEN 'Sabon Gari' ELSE n_name END AS value, n_nationkey % 3 <> 1 AS flagged,
           CASE n_nationkey % 3 WHEN 0 THEN 'de-concatenated; leftover ''tudunwada'' dropped' WHEN 1 THEN '' ELSE 'LGA not recognised' END AS reason FROM nation
    """
)
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = case(F.col("n_nationkey"), 3, F.lit("ZariaTudunWada"), F.lit("sabon gari"), F.col("n_name"))
    return transformed(read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw")), "raw", "lga_ng")


def _degrees(name: str, most: int):
    sql = f"""
    SELECT c_custkey, CASE WHEN k = 2 THEN NULL ELSE round(CASE k WHEN 1 THEN -(d + m / 60.0) ELSE d + m / 60.0 END, 6) END AS value, k = 2 AS flagged
    FROM (SELECT c_custkey, c_custkey % 3 AS k, CAST(c_custkey % {most} AS DOUBLE) AS d, CAST(c_custkey % 60 AS DOUBLE) AS m FROM customer)
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d, m = (F.col("c_custkey") % most).cast("string"), (F.col("c_custkey") % 60).cast("string")
        north, south = ("N", "S") if name == "latitude" else ("E", "W")
        raw = case(F.col("c_custkey"), 3, F.concat(d, F.lit("°"), m, F.lit("'" + north)), F.concat(d, F.lit("° "), m, F.lit("' " + south)), F.lit("999"))
        out = transformed(read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw", name)
        return out.select("c_custkey", F.when(~F.col("flagged"), F.col("value")).cast("double").alias("value"), "flagged")

    run.__name__ = name
    return query(sql)(run)


_degrees("latitude", 90)
_degrees("longitude", 180)


@query("SELECT c_custkey, CAST(c_custkey % 90 + 0.25 AS DOUBLE) AS lat, CAST(-(c_custkey % 180) - 0.5 AS DOUBLE) AS long FROM customer")
def split_geopoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, long = (F.col("c_custkey") % 90 + 0.25).cast("string"), (-(F.col("c_custkey") % 180) - 0.5).cast("string")
    raw = case(F.col("c_custkey"), 3, F.concat(lat, F.lit(", "), long), F.concat(F.lit("("), lat, F.lit("; "), long, F.lit(")")), F.concat(lat, F.lit(" "), long))
    df = read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return staged(df, lambda let: {n: c.cast("double") for n, c in zip(("lat", "long"), reshape.split_geopoint("raw", let), strict=True)}).drop("raw")


@query("SELECT p_partkey, trim(split_part(p_type, ' ', 1)) AS first, CASE WHEN instr(p_type, ' ') > 0 THEN trim(substr(p_type, instr(p_type, ' ') + 1)) END AS rest FROM part")
def split_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = reshape.split_by_delimiter("p_type", " ", 1)
    return read(spark, sf_dir, "part").select("p_partkey", a.alias("first"), b.alias("rest"))


@query("SELECT s_suppkey, 'Tunde' AS first, 'Supplier' || s_suppkey AS surname FROM supplier")
def split_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    raw = case(F.col("s_suppkey"), 2, F.concat(F.lit("SUPPLIER"), key, F.lit(", tunde")), F.concat(F.lit(" TUNDE  supplier"), key))
    first, surname = reshape.split_name("raw")
    return read(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).select("s_suppkey", first.alias("first"), surname.alias("surname"))


@query("SELECT p_partkey, trim(p_brand || ' units') AS text, CAST(p_size * 1000 AS VARCHAR) AS number FROM (SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS p_brand, p_size FROM part)")
def split_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.regexp_replace("p_brand", "[^A-Za-z]", "")
    text, number = reshape.split_number_text("raw")
    raw = F.concat(brand, F.lit(" "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" units"))
    return read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", text.alias("text"), number.alias("number"))


@query("SELECT p_partkey, p_brand || CASE WHEN p_size > 25 THEN '-' || p_type ELSE '' END || '-' || CAST(p_size AS VARCHAR) AS merged FROM part")
def merge_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").withColumn("t", F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit("  ")))
    return df.select("p_partkey", reshape.merge_columns(["p_brand", "t", "p_size"], "-").alias("merged"))


@query("SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN '' ELSE substr(sha256(trim(c_name)), 1, 12) END AS c_name, regexp_replace(regexp_replace(regexp_replace(c_mktsegment, '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g') AS segment, '[' || CASE WHEN regexp_full_match(CAST(c_custkey AS VARCHAR), '\\d+') THEN length(CAST(c_custkey AS VARCHAR)) || ' digits]' END AS key_shape FROM customer")
def anonymise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.quality import anonymise

    hashed, _ = anonymise(read(spark, sf_dir, "customer"), ["c_name"])
    return hashed.select("c_custkey", "c_name", X.mask("c_mktsegment").alias("segment"), X.shape("c_custkey").alias("key_shape"))


_LANGUAGES = ("de", "en", "es", "fr")
_STOP = {lang: "[" + ", ".join(f"'{w}'" for w in language.STOP_WORDS[lang]) + "]" for lang in _LANGUAGES}
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: list_contains({words}, x))) AS n_{lang}" for lang, words in _STOP.items())
_BEST = "greatest(n_de, n_en, n_es, n_fr)"


@query(
    f"""
    SELECT doc_id, CASE WHEN length(text) < 12 OR {_BEST} = 0 THEN NULL WHEN n_fr = {_BEST} THEN 'fr' WHEN n_es = {_BEST} THEN 'es' WHEN n_en = {_BEST} THEN 'en' ELSE 'de' END AS detected
    FROM (SELECT doc_id, text, {_COUNTS} FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents))
    """
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", language.detect("text", _LANGUAGES).alias("detected"))


@query(
    """
    SELECT key, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 9) AS weight FROM (
      SELECT key, bucket, CAST(count(*) AS DOUBLE) AS w FROM (
        SELECT key, CAST(('0x' || substr(md5(gram), 31, 2))::INT AS INT) AS bucket FROM (
          SELECT item_id AS key, unnest(list_concat(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3)), regexp_extract_all(t, '[a-z0-9]+'))) AS gram
          FROM (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark))) GROUP BY ALL)
    """
)
def lexical_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.lexical_counts(read(spark, sf_dir, "benchmark"), "item_id", "text").select("key", "bucket", F.round("weight", 9).alias("weight"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS \"props.k\" FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.sources.files import flatten

    nested = read(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k string").alias("props"))
    return flatten(nested).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(text, '\\s+', ' ', 'g')), '^ +| +$', '', 'g'))) AS cell FROM documents")
def norm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.norm_cell("text").cast("binary")).alias("cell"))
