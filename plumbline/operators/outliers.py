"""Outliers of numeric columns: evaluation, detection and treatment.

Fences come from one aggregation and are joined as one row. Exact percentiles keep a count for
each distinct value; `approx` uses a sketch of bounded size instead, for columns of huge variety.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

IQR_WIDTH, MIN_LIST, MIN_EVALUATE, Z_LIMIT = 1.5, 8, 5, 3.0


def number(df: DataFrame, column: str) -> Column:
    """A numeric column as it is, any other by its text."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    return c.cast("double") if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else X.stripped_number(c)


def _quartiles(x: Column, approx: bool) -> Column:
    return F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000) if approx else F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def skew(x: Column) -> Column:
    """Adjusted sample skewness; 0 for fewer than three values or no spread."""
    n = F.count(x)
    return F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0)).otherwise(0.0)


def fences(df: DataFrame, column: str, method: str = "iqr", approx: bool = False) -> DataFrame:
    """One row (n, low, high)."""
    x = number(df, column)
    if method == "iqr":
        one = df.agg(F.count(x).alias("n"), _quartiles(x, approx).alias("q"))
        width = F.col("q")[2] - F.col("q")[0]
        return one.select("n", (F.col("q")[0] - IQR_WIDTH * width).alias("low"), (F.col("q")[2] + IQR_WIDTH * width).alias("high"))
    if method == "zscore":
        one = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
        return one.select("n", (F.col("m") - Z_LIMIT * F.col("s")).alias("low"), (F.col("m") + Z_LIMIT * F.col("s")).alias("high"))
    raise ValueError(f"method is iqr or zscore, not {method!r}")


def find_outliers(df: DataFrame, columns: list[str], method: str = "iqr", approx: bool = False) -> DataFrame:
    """All columns of the rows outside the fences of a column, with `column`, `value`, `low`, `high` and `reason`."""
    out = None
    for c in columns:
        bounds = fences(df, c, method, approx).where(F.col("n") >= MIN_LIST)
        x = number(df, c)
        hit = df.withColumn("value", x).join(F.broadcast(bounds), (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))  # bounds: one row
        hit = hit.withColumn("column", F.lit(c)).withColumn("reason", F.concat(F.lit("outside "), F.round("low", 2).cast("string"), F.lit(".."), F.round("high", 2).cast("string"))).drop("n")
        out = hit if out is None else out.unionByName(hit)
    return out


def evaluate(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """(column, count, missing, min, q1, median, q3, max, skew, suggested_method, shape, note): one row a column."""
    each = []
    for i, c in enumerate(columns):
        x = number(df, c)
        each.append(F.struct(F.count(x).alias("count"), (F.count("*") - F.count(x)).alias("missing"), F.min(x).alias("min"), _quartiles(x, approx).alias("q"), F.max(x).alias("max"), skew(x).alias("skew")).alias(f"c{i}"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s")) for i, c in enumerate(columns)])
    out = df.agg(*each).select(F.inline(rows))
    few = F.col("s.count") < MIN_EVALUATE
    value = lambda c, places: F.when(~few, F.round(c, places))
    lean = F.col("s.skew")
    return out.select(
        "column", F.col("s.count").alias("count"), F.col("s.missing").alias("missing"),
        value("s.min", 3).alias("min"), value(F.col("s.q")[0], 3).alias("q1"), value(F.col("s.q")[1], 3).alias("median"), value(F.col("s.q")[2], 3).alias("q3"), value("s.max", 3).alias("max"),
        value("s.skew", 2).alias("skew"),
        F.when(~few, F.when(F.abs(lean) >= 1, F.lit("IQR")).otherwise(F.lit("Z-score"))).alias("suggested_method"),
        F.when(~few, F.when(lean >= 1, F.lit("right-skewed")).when(lean <= -1, F.lit("left-skewed")).otherwise(F.lit("roughly symmetric"))).alias("shape"),
        F.when(few, F.lit("too few numbers to evaluate")).alias("note"),
    )


def treat(df: DataFrame, column: str, how: str = "cap", method: str = "iqr", approx: bool = False) -> DataFrame:
    """Outliers of a column flagged (`keep`, adds _outlier), capped at the fences (`cap`), or their rows removed (`remove`)."""
    bounds = fences(df, column, method, approx).select(F.when(F.col("n") >= MIN_LIST, F.col("low")).alias("__low"), F.when(F.col("n") >= MIN_LIST, F.col("high")).alias("__high"))
    met = df.crossJoin(F.broadcast(bounds))  # one row
    x = number(df, column)
    out_of = F.coalesce((x < F.col("__low")) | (x > F.col("__high")), F.lit(False))
    if how == "keep":
        return met.withColumn("_outlier", out_of).drop("__low", "__high")
    if how == "remove":
        return met.where(~out_of).drop("__low", "__high")
    if how == "cap":
        capped = F.when(x < F.col("__low"), F.col("__low")).when(x > F.col("__high"), F.col("__high"))
        kind = df.schema[column].dataType
        shown = X.number_text(capped) if kind.typeName() == "string" else capped.cast(kind)
        return met.withColumn(column, F.when(out_of, shown).otherwise(F.col(f"`{column}`"))).drop("__low", "__high")
    raise ValueError(f"how is keep, cap or remove, not {how!r}")
