"""Summaries, validation, key detection and pseudonyms."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import values as V
from plumbline.operators import outliers as O
from plumbline.plans.long import value_counts


def summarise(df: DataFrame, blank_is_missing: bool = True, order: list[str] | None = None, types: bool = False) -> DataFrame:
    """(column, detected_type, filled, missing_pct, distinct, example): one row a column, by one aggregation.

    The example is the first non-blank value by `order`, or the least without one. detected_type is
    filled with `types`, at the cost of a profile.
    """
    found = {}
    if types:
        from plumbline.operators.profile import profile

        found = {p.column: p.semantic_type for p in profile(df)}
    said = X.strip(F.coalesce("value", F.lit(""))) != ""
    filled = said if blank_is_missing else F.col("value").isNotNull()
    first = F.min_by(F.when(said, F.col("value")), F.when(said, F.col("place") if order else F.col("value")))
    one = value_counts(df, order=order).groupBy("column").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"), F.count(F.when(filled, 1)).alias("distinct"), F.coalesce(first, F.lit("")).alias("example")
    )
    # a table without rows has columns all the same
    names = F.from_json(F.lit(json.dumps([{"column": c, "detected_type": found.get(c, "")} for c in df.columns])), "array<struct<column: string, detected_type: string>>")
    every = df.sparkSession.range(1).select(F.inline(names))
    out = every.join(one, "column", "left")
    missing = F.round(100 * (F.col("total") - F.col("filled")) / F.greatest(F.col("total"), F.lit(1)), 1)
    return out.select("column", "detected_type", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce(missing, F.lit(0.0)).alias("missing_pct"), F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce("example", F.lit("")).alias("example"))


@dataclass
class Rule:
    """A check of one column: required, email, phone or range (low, high)."""

    column: str
    check: str
    low: float | None = None
    high: float | None = None

    def issue(self, df: DataFrame) -> Column:
        """The issue's name, or null."""
        v = X.strip(X.string(f"`{self.column}`"))
        said = v != ""
        if self.check == "required":
            return F.when(~said, F.lit("required value missing"))
        if self.check == "email":
            return F.when(said & ~v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit("invalid email"))
        if self.check == "phone":
            return F.when(said & (F.length(F.regexp_replace(v, "[^0-9]", "")) < 7), F.lit("phone too short"))
        if self.check == "range":
            x = O.number(df, self.column)
            low = F.coalesce(x < self.low, F.lit(False)) if self.low is not None else F.lit(False)
            high = F.coalesce(x > self.high, F.lit(False)) if self.high is not None else F.lit(False)
            return F.when(said & x.isNull(), F.lit("not a number")).when(low | high, F.lit("out of range"))
        raise ValueError(f"check is required, email, phone or range, not {self.check!r}")


def rules_for(df: DataFrame, required: list[str] | None = None) -> list[Rule]:
    """Rules from the columns' semantic types, and the required columns."""
    from plumbline.operators.profile import profile

    typed = [Rule(p.column, p.semantic_type) for p in profile(df) if p.semantic_type in ("email", "phone")]
    return [Rule(c, "required") for c in required or []] + typed


def validate(df: DataFrame, rules: list[Rule], row: list[str]) -> DataFrame:
    """(row columns..., column, value, issue): every broken rule, in one pass without a shuffle. `row`: columns that name a row."""
    if not rules:
        return df.select(*row).limit(0).select(*row, F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("issue"))
    found = F.array(*[F.struct(F.lit(r.column).alias("column"), X.string(f"`{r.column}`").alias("value"), r.issue(df).alias("issue")) for r in rules])
    return df.select(*row, F.inline(found)).where("issue is not null")


def detect_keys(df: DataFrame, typed: dict[str, str] | None = None) -> list[str]:
    """Identifier, phone and e-mail columns that are 90 % distinct; without one, any that are 98 %."""
    if typed is None:
        from plumbline.operators.profile import profile

        typed = {p.column: p.semantic_type for p in profile(df)}
    ratios = sorted(distinct_ratios(df).collect(), key=lambda r: df.columns.index(r["column"]))  # one row a column
    keys = [r["column"] for r in ratios if typed.get(r["column"]) in ("identifier", "phone", "email") and r["ratio"] >= 0.9]
    return keys or [r["column"] for r in ratios if r["filled"] and r["ratio"] >= 0.98]


def distinct_ratios(df: DataFrame) -> DataFrame:
    """(column, filled, distinct, ratio)."""
    said = F.col("value").isNotNull()
    one = value_counts(df).groupBy("column").agg(F.coalesce(F.sum(F.when(said, F.col("n"))), F.lit(0)).alias("filled"), F.count("value").alias("distinct"))
    return one.withColumn("ratio", F.col("distinct") / F.greatest(F.col("filled"), F.lit(1)))


def anonymise(df: DataFrame, columns: list[str] | None = None, how: str = "hash") -> tuple[DataFrame, dict]:
    """Columns of identifiers, phones, e-mails and names hashed, masked or dropped.

    Without `columns` they are found by profile; short plain numbers (ages, counts) are left alone.
    """
    if columns is None:
        from plumbline.operators.profile import profile

        typed = [p.column for p in profile(df) if p.semantic_type in ("identifier", "phone", "email", "name")]
        columns = [c for c in typed if not _short_numbers(df, typed)[c]] if typed else []
    if how == "drop":
        out = df.drop(*columns)
    elif how in ("hash", "mask"):
        f = X.pseudonym if how == "hash" else X.mask
        out = df.withColumns({c: f(f"`{c}`") for c in columns}) if columns else df
    else:
        raise ValueError(f"how is hash, mask or drop, not {how!r}")
    return out, {"columns_masked": len(columns), "which": ", ".join(columns)}


def _short_numbers(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    each = []
    for c in columns:
        v = X.strip(X.string(f"`{c}`"))
        number = v.rlike(r"^[0-9.]*[0-9][0-9.]*$")
        each += [F.avg(F.when(v != "", number.cast("double"))), F.max(F.when(number, F.length(v)))]
    row = df.agg(*each).first()
    return {c: (row[2 * i] or 0) > 0.9 and (row[2 * i + 1] or 0) <= 4 for i, c in enumerate(columns)}


def valid_share(df: DataFrame, column: str, kind: str) -> Column:
    """Share of a column's non-blank values that are e-mails, or numbers."""
    v = X.clean(f"`{column}`")
    test = V.is_email(v) if kind == "email" else X.stripped_number(v).isNotNull()
    return F.avg(F.when(v != "", test.cast("double")))


def scores(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row (n, precision, recall, accuracy) of predictions against labels; null says `none of them`."""
    p, a = F.col(f"`{predicted}`"), F.col(f"`{actual}`")
    hit = (p.isNotNull() & p.eqNullSafe(a)).cast("long")
    right = p.eqNullSafe(a).cast("long")
    share = lambda x, n: F.coalesce(F.try_divide(F.sum(x), n), F.lit(1.0))
    return df.agg(F.count("*").alias("n"), share(hit, F.count(p)).alias("precision"), share(hit, F.count(a)).alias("recall"), share(right, F.count("*")).alias("accuracy"))
