"""Table operators: joins, duplicates, outliers, distributions, profiles, resolution, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import clusters, distribution, domains, duplicates, embeddings, headers, joins, knowledge, outliers, profile, quality, resolve, review, toolkit, typeclf, vocabulary
from plumbline.plans.shared import new_path
from plumbline.queries.columns import customer_run
from plumbline.queries.registry import query, read
from plumbline.sources import export, files, router
from plumbline.streaming import streams

# --- joins ---


def _orders_customers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Whole tables; a third of the orders' keys and a fifth of the customers' are changed, so that they meet nothing."""
    moved = lambda key, every, by: F.when(F.col(key) % every == 0, F.col(key) + by).otherwise(F.col(key)).alias(key)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", moved("o_custkey", 3, 1_000_000_000), "o_totalprice")
    customers = read(spark, sf_dir, "customer").select(moved("c_custkey", 5, 2_000_000_000), "c_name", "c_nationkey")
    return [orders, customers]


def _match(how: str, sql_join: str):
    sql = f"""
    SELECT CAST(coalesce(o_custkey, c_custkey) AS VARCHAR) AS _key, o_orderkey, o_totalprice, c_name, c_nationkey
    FROM (SELECT * REPLACE (CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey) FROM orders) o
    {sql_join} JOIN (SELECT * REPLACE (CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 2000000000 ELSE c_custkey END AS c_custkey) FROM customer) c ON o_custkey = c_custkey
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return joins.match(_orders_customers(spark, sf_dir), how, ["o_custkey", "c_custkey"])

    run.__name__ = f"match_{how}"
    return query(sql)(run)


_match("inner", "INNER")
_match("left", "LEFT")
_match("outer", "FULL")


@query(
    """
    SELECT CAST(n_nationkey AS VARCHAR) AS _key, n_name, n_regionkey, s_name, s_acctbal, c_name, c_acctbal
    FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey
    """
)
def match_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    supplier = read(spark, sf_dir, "supplier").select("s_nationkey", "s_name", "s_acctbal")
    customer = read(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_acctbal")
    return joins.match([nation, supplier, customer], "inner", ["n_nationkey", "s_nationkey", "c_nationkey"])


@query(
    """
    WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) v FROM orders WHERE o_custkey IS NOT NULL), b AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) v FROM customer)
    SELECT 'custkey' AS key, 'Cust Key' AS left_column, 'cust_key' AS right_column, (SELECT count(*) FROM a JOIN b USING (v)) AS common,
           (SELECT count(*) FROM a JOIN b USING (v)) / CAST(least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS DOUBLE) AS overlap
    """
)
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("Cust Key"), "o_orderkey")
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_key"), "c_name")
    return joins.key_overlaps(a, b)


@query(
    """
    SELECT 'added' AS _status, CAST(c_custkey + 1000000 AS VARCHAR) AS key, '' AS changed_columns FROM customer WHERE c_custkey % 10 = 0
    UNION ALL SELECT 'removed', CAST(c_custkey AS VARCHAR), '' FROM customer WHERE c_custkey % 10 = 0
    UNION ALL SELECT 'changed', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 14 = 7 AND c_mktsegment <> 'NEW' THEN 'c_acctbal, c_mktsegment' ELSE 'c_acctbal' END FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 0
    """
)
def compare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer")
    new = old.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = new.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 14 == 7, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    new = new.withColumn("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")))
    return joins.compare(old, new, "c_custkey")


@query(
    """
    SELECT 'file1' AS _source_file, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, '' AS balance FROM customer
    UNION ALL SELECT 'file2', CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_acctbal AS VARCHAR) FROM supplier
    """
)
def combine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return joins.combine([a, b])


# --- duplicates ---
_CELL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_GROUPS = f"SELECT {_CELL} AS k, count(*) AS size, min(doc_id) AS first FROM documents WHERE {_CELL} <> '' GROUP BY 1 HAVING count(*) > 1"


@query(f"WITH g AS (SELECT *, row_number() OVER (ORDER BY size DESC, first) AS n FROM ({_GROUPS})) SELECT 'G' || n || ' (exact)' AS _dup_group, doc_id, source FROM documents JOIN g ON {_CELL} = k")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return duplicates.find_duplicates(df, ["text"], ["doc_id"])[0].drop("text")


def _dedupe(keep: str, order: str):
    sql = f"SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {_CELL} ORDER BY {order}) AS n FROM documents) WHERE n = 1 OR {_CELL} = ''"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("source"), "n_chars")
        return duplicates.dedupe(df, ["text"], keep, ["doc_id"]).drop("text")

    run.__name__ = f"dedupe_{keep}"
    return query(sql.replace("SELECT doc_id, source", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source"))(run)


_dedupe("first", "doc_id")
_dedupe("last", "doc_id DESC")
_dedupe("complete", "doc_id % 3 = 0, doc_id")


@query(
    """
    SELECT 'name' AS column, count(DISTINCT name) AS distinct_raw, count(DISTINCT lower(trim(name))) AS distinct_key, count(DISTINCT name) - count(DISTINCT lower(trim(name))) AS variants,
           avg(CASE WHEN regexp_matches(name, '[;,/|]') THEN 1.0 ELSE 0.0 END) AS multi_share, count(DISTINCT lower(trim(name))) < count(DISTINCT name) AS warn_variants, avg(CASE WHEN regexp_matches(name, '[;,/|]') THEN 1.0 ELSE 0.0 END) >= 0.1 AS warn_multi
    FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ' ELSE p_name || ';' || p_brand END AS name FROM part)
    """
)
def dup_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" "))).otherwise(F.concat("p_name", F.lit(";"), "p_brand"))
    return duplicates.confusion(read(spark, sf_dir, "part").select(name.alias("name")))


@query(
    """
    SELECT 'l_returnflag' AS a, 'copy' AS b, count(*) FILTER (copy <> '') AS both, count(*) FILTER (copy <> '' AND copy = l_returnflag) AS equal, count(*) FILTER (copy <> '' AND copy = l_returnflag) / CAST(count(*) FILTER (copy <> '') AS DOUBLE) AS overlap
    FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'X' ELSE l_returnflag END AS copy FROM lineitem)
    """
)
def dup_fields_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    copy = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "X").otherwise(F.col("l_returnflag"))
    return duplicates.field_overlaps(read(spark, sf_dir, "lineitem").select("l_returnflag", copy.alias("copy")))


# --- quality ---
@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, '' AS detected_type, count({c}) AS filled, CAST(0.0 AS DOUBLE) AS missing_pct, count(DISTINCT {c}) AS distinct, (SELECT CAST({c} AS VARCHAR) FROM customer ORDER BY c_custkey LIMIT 1) AS example FROM customer"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
)
def summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summarise(read(spark, sf_dir, "customer"), order=["c_custkey"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS filled, count(DISTINCT {c}) AS distinct, count(DISTINCT {c}) / CAST(greatest(count({c}), 1) AS DOUBLE) AS ratio FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def detect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distinct_ratios(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    """
    WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'x@y' ELSE 'x@y.z' END AS mail, CASE WHEN c_custkey % 6 = 0 THEN '12-34' ELSE '0803 123 4567' END AS tel, c_acctbal FROM customer)
    SELECT c_custkey, 'name' AS column, name AS value, 'required value missing' AS issue FROM c WHERE trim(name) = ''
    UNION ALL SELECT c_custkey, 'mail', mail, 'invalid email' FROM c WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'tel', tel, 'phone too short' FROM c WHERE c_custkey % 6 = 0
    UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR), 'out of range' FROM c WHERE c_acctbal < 0 OR c_acctbal > 9000
    """
)
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(key % 4 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(key % 3 == 0, "x@y").otherwise("x@y.z").alias("mail"), F.when(key % 6 == 0, "12-34").otherwise("0803 123 4567").alias("tel"), "c_acctbal")
    rules = [quality.Rule("name", "required"), quality.Rule("mail", "email"), quality.Rule("tel", "phone"), quality.Rule("c_acctbal", "range", 0, 9000)]
    return quality.validate(df, rules, ["c_custkey"])


# --- outliers and distributions ---
_FENCE = "SELECT quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS low, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS high FROM v"
_SPREAD = "WITH v AS (SELECT event_id, value * value * value AS x FROM events)"


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", (F.col("value") * F.col("value") * F.col("value")).alias("x"))


@query(f"{_SPREAD}, f AS ({_FENCE}) SELECT event_id, x AS value, round(low, 6) AS low, round(high, 6) AS high FROM v, f WHERE x < low OR x > high")
def outlier_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.find_outliers(_spread(spark, sf_dir), ["x"]).select("event_id", "value", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"{_SPREAD}, f AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM v) SELECT event_id FROM v, f WHERE abs(x - m) > 3 * s")
def outlier_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.find_outliers(_spread(spark, sf_dir), ["x"], "zscore").select("event_id")


@query(f"{_SPREAD}, f AS ({_FENCE}) SELECT event_id, round(CASE WHEN x < low THEN low WHEN x > high THEN high ELSE x END, 6) AS x FROM v, f")
def winsorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.treat(_spread(spark, sf_dir), "x", "cap").select("event_id", F.round("x", 6).alias("x"))


@query(f"{_SPREAD}, f AS ({_FENCE}) SELECT event_id FROM v, f WHERE x BETWEEN low AND high")
def outlier_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.treat(_spread(spark, sf_dir), "x", "remove").select("event_id")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count({c}) AS count, CAST(0 AS BIGINT) AS missing, round(min({c}), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS q1, round(median({c}), 3) AS median, round(quantile_cont({c}, 0.75), 3) AS q3, round(max({c}), 3) AS max, round(skewness({c}), 2) AS skew,
        CASE WHEN abs(skewness({c})) >= 1 THEN 'IQR' ELSE 'Z-score' END AS suggested_method, CASE WHEN skewness({c}) >= 1 THEN 'right-skewed' WHEN skewness({c}) <= -1 THEN 'left-skewed' ELSE 'roughly symmetric' END AS shape, CAST(NULL AS VARCHAR) AS note FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM lineitem)"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
)
def outlier_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.evaluate(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    """
    WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), n AS (SELECT least(CAST(floor((o_totalprice - a) / ((b - a) / 12)) AS INTEGER), 11) AS bin, count(*) AS count FROM orders, e GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(a + i * ((b - a) / 12), 3) AS lo, CASE WHEN i = 11 THEN round(b, 3) ELSE round(a + i * ((b - a) / 12) + (b - a) / 12, 3) END AS hi, coalesce(count, 0) AS count FROM e, range(12) r(i) LEFT JOIN n ON n.bin = i
    """
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.histogram(read(spark, sf_dir, "orders"), "o_totalprice")


@query(
    """
    WITH q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT c_acctbal AS x FROM customer))
    SELECT count(*) AS count, round(avg(c_acctbal), 3) AS mean, round(median(c_acctbal), 3) AS median, round(min(c_acctbal), 3) AS min, round(max(c_acctbal), 3) AS max, round(any_value(q1), 3) AS q1, round(any_value(q3), 3) AS q3,
           round(any_value(q1 - 1.5 * (q3 - q1)), 3) AS outlier_low, round(any_value(q3 + 1.5 * (q3 - q1)), 3) AS outlier_high, count(*) FILTER (c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)) AS outliers, round(skewness(c_acctbal), 2) AS skew
    FROM customer, q
    """
)
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.numeric_stats(read(spark, sf_dir, "customer"), "c_acctbal")


@query("SELECT substr(p_brand, 1, 28) AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 8")
def category_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.category_top(read(spark, sf_dir, "part"), "p_brand")


@query(
    """
    WITH n AS (SELECT p_type, count(*) AS c FROM part WHERE p_type NOT IN ('', '-') GROUP BY 1)
    SELECT count(*) AS distinct, CAST(sum(c) AS BIGINT) AS filled, (SELECT count(*) FROM part) - CAST(sum(c) AS BIGINT) AS missing, round(sum(c) / CAST((SELECT count(*) FROM part) AS DOUBLE), 3) AS fill_share,
           CAST((SELECT sum(c) FROM (SELECT c FROM n ORDER BY c DESC, p_type LIMIT 8)) AS BIGINT) AS top_count, CAST(sum(c) - (SELECT sum(c) FROM (SELECT c FROM n ORDER BY c DESC, p_type LIMIT 8)) AS BIGINT) AS other FROM n
    """
)
def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.category_profile(read(spark, sf_dir, "part"), "p_type")


@query(
    """
    SELECT count(*) AS filled, CAST(0 AS BIGINT) AS missing, CAST(1.0 AS DOUBLE) AS fill_share, count(DISTINCT v) AS distinct, round(count(DISTINCT v) / CAST(count(*) AS DOUBLE), 3) AS unique_share,
           round(count(*) FILTER (length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15) / CAST(count(*) AS DOUBLE), 3) AS valid_format_share,
           (SELECT CAST(length(regexp_replace(c_name, '[^0-9]', '', 'g')) AS BIGINT) AS n FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common_length FROM (SELECT trim(c_name) AS v FROM customer)
    """
)
def identifier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.identifier_profile(read(spark, sf_dir, "customer"), "c_name")


@query("SELECT 'l_quantity' AS column, count(*) AS before_count, count(*) FILTER (l_quantity <= 40) AS after_count, CAST(0 AS BIGINT) AS outliers_change FROM lineitem")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "lineitem").select("l_quantity")
    pairs = distribution.before_after(before, before.where("l_quantity <= 40"))
    return spark.createDataFrame([(p["column"], p["before"]["count"], p["after"]["count"], p["outliers_change"]) for p in pairs], "column string, before_count long, after_count long, outliers_change long")


# --- profiles ---
def _rates(table: str, columns: list[str]) -> str:
    part = """SELECT '{c}' AS column, count({c}) AS n, count(DISTINCT {c}) AS distinct, round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_len,
      round(avg(CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^[A-Za-z0-9]+$') AND regexp_matches(CAST({c} AS VARCHAR), '[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS alnum,
      round(avg(CASE WHEN regexp_matches(regexp_replace(CAST({c} AS VARCHAR), '[,$%\\s]', '', 'g'), '^-?[0-9]+([.][0-9]+)?$') THEN 1.0 ELSE 0.0 END), 6) AS numeric,
      round(avg(CASE WHEN regexp_matches(regexp_replace(CAST({c} AS VARCHAR), '[,$%\\s]', '', 'g'), '^-?[0-9]+[.][0-9]+$') THEN 1.0 ELSE 0.0 END), 6) AS decimal,
      round(avg(CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '[A-Za-z]') THEN 1.0 ELSE 0.0 END), 6) AS letters FROM {t}"""
    return " UNION ALL ".join(part.format(c=c, t=table) for c in columns)


@query(_rates("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def profile_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profile.rates(read(spark, sf_dir, "customer"), exact=True)
    return r.select("column", "n", "distinct", *[F.round(c, 6).alias(c) for c in ("avg_len", "alnum", "numeric", "decimal", "letters")])


@query(
    """
    WITH d AS (SELECT extract(day FROM o_orderdate) AS dd, extract(month FROM o_orderdate) AS mm FROM orders)
    SELECT 'd' AS column, count(*) AS dates, CAST(0 AS BIGINT) AS ymd, count(*) FILTER (dd > 12) AS dmy, CAST(0 AS BIGINT) AS mdy, CASE WHEN count(*) FILTER (dd > 12) > 0 THEN 'DMY' END AS date_order FROM d
    """
)
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "d/M/yyyy").alias("d"))
    r = profile.rates(df).select("column", "dates", "ymd", "dmy", "mdy")
    total = F.col("ymd") + F.col("dmy") + F.col("mdy")
    pick = F.when(F.col("ymd") / total >= 0.51, "YMD").when(F.col("dmy") / total >= 0.51, "DMY").when(F.col("mdy") / total >= 0.51, "MDY")
    return r.withColumn("date_order", F.when(total > 0, pick))


@query("SELECT 'x' AS column, count(*) AS separated, count(*) FILTER (o_totalprice >= 1000) AS both_comma, CAST(0 AS BIGINT) AS both_dot FROM orders")
def decimal_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select(F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("x"))
    return profile.rates(df).select("column", "separated", "both_comma", "both_dot")


def _profiles(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(p.column, p.semantic_type, round(float(p.confidence), 4), p.transform or "") for p in profile.profile(df)], "column string, semantic_type string, confidence double, transform string")


@query("SELECT * FROM (VALUES ('c_custkey', 'identifier'), ('c_name', 'free_text'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) t(\"column\", semantic_type)")
def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, read(spark, sf_dir, "customer")).select("column", "semantic_type")


@query()
def auto_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = profile.profile_to_plan(profile.profile(read(spark, sf_dir, "events")))
    return spark.createDataFrame([(m.source_column, m.target_field, m.transform) for m in plan.mappings], "source_column string, target_field string, transform string")


@query("SELECT event_id, event_type FROM events")
def quick_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = toolkit.quick_clean(read(spark, sf_dir, "events"))
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), F.lower("event_type").alias("event_type"))


@query(
    """
    SELECT 'name' AS column, '  ' || upper(c_name) || ' ' AS before, c_name AS after, count(*) AS count FROM customer GROUP BY ALL
    UNION ALL SELECT 'cust_no', c_name, regexp_replace(c_name, '[^0-9]', '', 'g'), count(*) FROM customer GROUP BY ALL
    """
)
def overview_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.changed_values(customer_run(spark, sf_dir))


@query()
def spotcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.spotcheck(customer_run(spark, sf_dir), 20, 7)


# --- vocabulary, resolution, similarity ---

@query(
    """
    WITH v AS (SELECT raw, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN lower(p_type) ELSE p_type || '!' END AS raw FROM part) GROUP BY 1),
    k AS (SELECT raw, n, array_to_string(list_sort(string_split(trim(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g')), ' ')), '|') || '#' AS key FROM v)
    SELECT raw, n, key FROM k
    """
)
def induce_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.lower("p_type")).otherwise(F.concat("p_type", F.lit("!")))
    return vocabulary.induce_vocabulary(read(spark, sf_dir, "part").select(raw.alias("t")), "t").select("raw", "n", "key")


@query("SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS value FROM events")
def auto_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.queries.columns import transformed

    raw = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type"))
    return transformed(read(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "auto_categorical").select("event_id", "value")


_TYPOS = [("Kastina", "KATSINA"), ("kadna", "KADUNA"), ("Plateu", "PLATEAU"), ("cross rivers", "CROSS RIVER"), ("Ibadan", None), ("Kano State", "KANO")]
_TYPO_VALUES = ", ".join(f"({i}, '{t}', {repr(c) if c else 'NULL'})" for i, (t, c) in enumerate(_TYPOS))


@query(f"SELECT n_nationkey, raw, canonical FROM nation JOIN (VALUES {_TYPO_VALUES}) t(i, raw, canonical) ON n_nationkey % {len(_TYPOS)} = i")
def resolve_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(t) for t, _ in _TYPOS]), F.col("n_nationkey") % len(_TYPOS) + 1)
    df = read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw"))
    found = resolve.resolve_distinct(df, "raw", resolve.EntityResolver(profile.STATE_NAMES))
    return df.join(found.select(F.col("value").alias("raw"), "canonical"), "raw")


@query("SELECT * FROM (VALUES ('Zaria LGA', 'lga', 'Zaria'), ('Kano', 'is_state', 'KANO'), ('Nowhere at all', 'unknown', NULL)) t(value, kind, canonical)")
def admin_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Zaria LGA", "Kano", "Nowhere at all"]
    df = read(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, names)), F.col("n_nationkey") % 3 + 1).alias("v"))
    return domains.check_places(df, "v", "lga").select("value", "kind", "canonical")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Nigeria' WHEN 1 THEN 'Ghana' END AS v_canonical FROM nation")
def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 3 == 0, " NGA").when(F.col("n_nationkey") % 3 == 1, "ghana.").otherwise("Atlantis")
    df = read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("v"))
    return domains.Domains().resolved(df, "v", "country").drop("v")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 2 THEN NULL WHEN 1 THEN 'conflict' ELSE 'canonical' END AS known_kind, CASE n_nationkey % 3 WHEN 0 THEN 'RIVERS' END AS known_canonical FROM nation")
def knowledge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = knowledge.Corrections()
    said.say("state", "Port Harcourt", "RIVERS")
    said.say("state", "Abuja(Jos)", "FCT", "PLATEAU")
    raw = F.when(F.col("n_nationkey") % 3 == 0, "port-harcourt (PH)").when(F.col("n_nationkey") % 3 == 1, "Abuja(Jos)").otherwise("nothing")
    df = read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("v"))
    return knowledge.known(df, "v", "state", said.log(spark)).select("n_nationkey", "known_kind", "known_canonical")


@query()
def group_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    return clusters.group_similar(read(spark, sf_dir, "part").select(raw.alias("n")), "n").select("representative", "size")


@query()
def cluster_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("s")))
    return clusters.cluster_similar(read(spark, sf_dir, "part").select(raw.alias("n")), "n").select("representative", "size", "confidence", "score")


@query(
    """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.3 - 1e-9
    """
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search: every row whose id is divisible by 100 is a query against all rows. Vectors of chance are seldom
    close, so the threshold is 0.3 here; `semantic_pairs` has the usual one."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return embeddings.close_pairs(v, 0.3, queries=v.where("id % 100 = 0")).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(
    """
    WITH g AS (SELECT key, unnest(list_concat(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3)), regexp_extract_all(t, '[a-z0-9]+'))) AS gram
               FROM (SELECT DISTINCT trim(p_name) AS key, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS t FROM part WHERE trim(p_name) <> '')),
    w AS (SELECT key, CAST(('0x' || substr(md5(gram), 31, 2))::INT AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS w FROM g GROUP BY ALL),
    v AS (SELECT key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w),
    p AS (SELECT x.key AS a, y.key AS b, sum(x.w * y.w) AS s FROM v x JOIN v y ON x.bucket = y.bucket AND x.key < y.key GROUP BY ALL)
    SELECT a, b, round(s, 3) AS score FROM p WHERE s >= 0.62 - 1e-9
    """
)
def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.semantic_pairs(read(spark, sf_dir, "part"), "p_name")


# --- classifier ---
@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, round(avg(CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^[-+]?[0-9]+([.][0-9]*)?$') THEN 1.0 ELSE 0.0 END), 6) AS num, round(avg(length(CAST({c} AS VARCHAR))) / 40.0, 6) AS length,
        round(avg(CASE WHEN contains(CAST({c} AS VARCHAR), ' ') THEN 1.0 ELSE 0.0 END), 6) AS space, round(avg(CASE WHEN CAST({c} AS VARCHAR) IN ('0', '1') THEN 1.0 ELSE 0.0 END), 6) AS is_01 FROM customer"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    )
)
def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = typeclf.column_features(read(spark, sf_dir, "customer").drop("c_acctbal"))
    return f.select("column", *[F.round(c, 6).alias(c) for c in ("num", "length", "space", "is_01")])


@query()
def ml_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = typeclf.train(spark, per_kind=25, trees=40)
    return typeclf.predict(model, typeclf.column_features(read(spark, sf_dir, "customer")))


# --- streams ---
_QUALITY = """
    SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS rows, CAST(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_key
    FROM events GROUP BY ALL
"""


def _checked(df: DataFrame) -> DataFrame:
    checks = {"low": F.col("value") < 10, "no_key": F.get_json_object("props", "$.k").isNull()}
    out = streams.quality_windows(df.withColumn("ts", F.col("ts").cast("timestamp")), "ts", checks, by=["event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_QUALITY)
def quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(read(spark, sf_dir, "events"))


@query(_QUALITY)
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream that reads all there is and stops, in complete mode."""
    schema = read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "events"))
    out, name = _checked(source), f"q{abs(hash(new_path(spark, 'q')))}"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _folder(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A streaming source reads folders: the table's own, or a copy of it where the table is one file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        return f"{sf_dir}/{table}.parquet"
    copy = new_path(spark, "source")
    read(spark, sf_dir, table).write.parquet(copy)
    return copy


@query("SELECT event_id, upper(event_type) AS kind, value < 10 AS flagged FROM events")
def stream_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan run by a stream into a table, read back."""
    plan = {"mappings": [{"source_column": "event_type", "target_field": "kind", "transform": "upper", "params": {}}, {"source_column": "value", "target_field": "amount", "transform": "range_check", "params": {"min": 10}}]}
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(_folder(spark, sf_dir, "events"))
    out = new_path(spark, "stream")
    streams.run_plan_stream(source, plan, out, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "kind", "flagged")


@query("SELECT event_type, count(DISTINCT lower(event_type) || '|' || user_id) AS n FROM events GROUP BY 1")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each (type, user) of a stream, its repeats dropped within the watermark."""
    schema = read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(_folder(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = streams.dedupe_stream(source, ["event_type", "user_id"], "ts", "100000 days").select("event_type", X.string("user_id").alias("u"))
    out = new_path(spark, "deduped")
    kept.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "dedupe-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


# --- files, decisions, metrics ---
@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"x\"' AS c_name, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV in parts and read back, with separators and quotes in the values."""
    path = f"{new_path(spark, 'csv')}.csv"
    df = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(',\n"x"')).alias("c_name"), "c_mktsegment")
    export.to_csv(df, path)
    return router.read_any(spark, path)[0]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"id\", n_name AS \"nation.name\", CAST(n_regionkey AS VARCHAR) AS \"nation.region\" FROM nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_path(spark, 'json')}.json"
    nested = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"))
    nested.write.json(path)
    return files.read_json(spark, path, lines=True)[0]


@query(f"SELECT CAST(count(*) AS BIGINT) AS duplicate_groups, CAST(coalesce(sum(size - 1), 0) AS BIGINT) AS removable_rows FROM ({_GROUPS})")
def duplicate_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = duplicates.payload(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ["text"])
    return spark.createDataFrame([tuple(totals.values())], "duplicate_groups long, removable_rows long")


@query(f"SELECT row_number() OVER (ORDER BY size DESC, first) AS \"group\", size, first AS keep_row FROM ({_GROUPS}) ORDER BY 1 LIMIT 50")
def duplicate_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest groups with the row of each that would stay."""
    rows, _ = duplicates.payload(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], ["text"])
    return rows.select("group", "size", F.col("keep_row.doc_id").alias("keep_row"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'CHEAP' ELSE p_type END AS p_type, 'x' AS p_brand FROM part")
def merge_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = review.Decisions(set_all={"p_brand": "x"}, merges={"p_type": [{"into": "CHEAP", "members": ["ECONOMY", "PROMO"]}]})
    out, _ = review.apply_decisions(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), {"mappings": []}, decisions)
    return out


@query(
    """
    SELECT count(*) AS n, count(*) FILTER (p IS NOT NULL AND p = a) / CAST(count(p) AS DOUBLE) AS precision, count(*) FILTER (p IS NOT NULL AND p = a) / CAST(count(a) AS DOUBLE) AS recall,
           count(*) FILTER (p IS NOT DISTINCT FROM a) / CAST(count(*) AS DOUBLE) AS accuracy
    FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS p, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS a FROM orders)
    """
)
def accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select(F.when(key % 5 == 0, None).when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("p"), F.when(key % 11 != 0, F.col("o_orderstatus")).alias("a"))
    return quality.scores(df, "p", "a")


@query("SELECT * FROM (VALUES ('Ph No', 'phone', 'phone_ng'), ('D.O.B', 'date_of_birth', 'date_iso'), ('Surnam', 'surname', 'name')) t(source_column, target_field, transform)")
def header_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = headers.propose_plan(["Ph No", "D.O.B", "Surnam", "weird"])
    return spark.createDataFrame([(m["source_column"], m["target_field"], m["transform"]) for m in plan["mappings"]], "source_column string, target_field string, transform string")
