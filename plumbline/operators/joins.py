"""Matching, comparing and appending tables.

Keys are compared as text. Joins are declared and left to Spark: it broadcasts what it knows to be
small, sorts and merges the rest, and splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import header_key


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def key_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left_column, right_column, common, overlap) of columns with equal headers: the distinct
    values in both over those in the smaller. One job for each pair of columns, none for other columns."""
    left, right = ({header_key(c): c for c in d.columns} for d in (a, b))
    out = None
    for k in sorted(set(left) & set(right)):
        x = a.select(_text(left[k]).alias("v")).where("v is not null").distinct().withColumn("side", F.lit(1))
        y = b.select(_text(right[k]).alias("v")).where("v is not null").distinct().withColumn("side", F.lit(2))
        sides = x.unionByName(y).groupBy("v").agg(F.sum("side").alias("s"))
        n = sides.agg(F.coalesce(F.sum((F.col("s") != 2).cast("long")), F.lit(0)).alias("na"), F.coalesce(F.sum((F.col("s") != 1).cast("long")), F.lit(0)).alias("nb"), F.coalesce(F.sum((F.col("s") == 3).cast("long")), F.lit(0)).alias("common"))
        one = n.where("na > 0 and nb > 0").select(F.lit(k).alias("key"), F.lit(left[k]).alias("left_column"), F.lit(right[k]).alias("right_column"), "common", (F.col("common") / F.least("na", "nb")).alias("overlap"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else a.sparkSession.createDataFrame([], "key string, left_column string, right_column string, common long, overlap double")


def detect_key(dfs: list[DataFrame]) -> list[str]:
    """The name that each table has for the shared column whose values overlap most (ties: the greater header)."""
    per = [{header_key(c): c for c in d.columns} for d in dfs]
    shared = set(per[0]).intersection(*per[1:])
    ranked = sorted(((r["overlap"], r["key"]) for r in key_overlaps(dfs[0], dfs[1]).collect() if r["key"] in shared), reverse=True)  # columns, not rows
    if not ranked:
        raise ValueError("No shared key column found across the tables.")
    return [p[ranked[0][1]] for p in per]


def match(dfs: list[DataFrame], how: str = "outer", key: str | list[str] | None = None, null_matches: bool = True) -> DataFrame:
    """The tables joined one after the other on a key, which becomes `_key`; columns that clash get `_f2`, `_f3`.

    Null keys match each other as the text `nan` if null_matches, as in the files they come from.
    """
    if len(dfs) < 2:
        raise ValueError("Need at least two tables to match.")
    names = detect_key(dfs) if key is None else [key] * len(dfs) if isinstance(key, str) else key

    def keyed(d: DataFrame, name: str) -> DataFrame:
        k = F.coalesce(_text(name), F.lit("nan")) if null_matches else _text(name)
        return d.select(k.alias("_key"), *[f"`{c}`" for c in d.columns if c != name])

    out = keyed(dfs[0], names[0])
    for j, (d, name) in enumerate(zip(dfs[1:], names[1:], strict=True), 2):
        right = keyed(d, name)
        right = right.toDF(*[c if c == "_key" or c not in out.columns else f"{c}_f{j}" for c in right.columns])
        out = out.join(right, "_key", how)
    return out


def compare(old: DataFrame, new: DataFrame, key: str | None = None) -> DataFrame:
    """(_status, key, changed_columns): keys added to, removed from, or changed in `new`, by one full join.

    Keys must be unique in each table: a repeated one raises at run time.
    """
    ka, kb = detect_key([old, new]) if key is None else (key, key)
    common = [c for c in old.columns if c in new.columns and c not in (ka, kb)]

    def keyed(d: DataFrame, k: str) -> DataFrame:
        row = F.struct(*[F.coalesce(_text(c), F.lit("nan")).alias(f"c{i}") for i, c in enumerate(common)], F.lit(1).alias("here"))
        one = d.select(F.coalesce(_text(k), F.lit("nan")).alias("key"), row.alias("row")).groupBy("key").agg(F.count("*").alias("n"), F.max("row").alias("row"))
        return one.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col("key"))).cast("boolean")).otherwise(F.lit(True))).drop("n")

    a, b = keyed(old, ka).withColumnRenamed("row", "a"), keyed(new, kb).withColumnRenamed("row", "b")
    diffs = F.concat_ws(", ", *[F.when(F.col(f"a.c{i}") != F.col(f"b.c{i}"), F.lit(c)) for i, c in enumerate(common)])
    both = a.join(b, "key", "full_outer")
    status = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).when(diffs != "", F.lit("changed"))
    return both.select(status.alias("_status"), "key", F.when(status == "changed", diffs).otherwise(F.lit("")).alias("changed_columns")).where("_status is not null")


def compare_summary(result: DataFrame) -> dict:
    n = {r[0]: r[1] for r in result.groupBy("_status").count().collect()}
    return {s: n.get(s, 0) for s in ("added", "removed", "changed")}


def combine(dfs: list[DataFrame]) -> DataFrame:
    """The tables one under the other by column name, with `_source_file` (file1, file2) in front; gaps are ''."""
    if len(dfs) < 2:
        raise ValueError("Combine needs at least two tables.")
    order = list(dict.fromkeys(c for d in dfs for c in d.columns))
    tagged = [d.select(F.lit(f"file{i}").alias("_source_file"), *[_text(c).alias(c) for c in d.columns]) for i, d in enumerate(dfs, 1)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out.select("_source_file", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in order])
