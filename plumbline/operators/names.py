"""Gender estimates from first names: opt-in, by a table of names that the user supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

MIN_CONFIDENCE, CLEAR = 0.65, 0.4
NAME_WORDS = r"(?i)\b(name|surname|firstname|first name|fullname|full name|given|forename)\b"
OTHER_WORDS = r"(?i)\b(id|code|email|phone|amount|date|number|no\.?)\b"


def name_scores(df: DataFrame) -> DataFrame:
    """(column, score): how much each column looks like one of names, from its header and all its values."""
    import re

    each, base = [], []
    for i, c in enumerate(df.columns):
        header = c.replace("_", " ")
        base.append(0.6 * bool(re.search(NAME_WORDS, header)) - 0.5 * bool(re.search(OTHER_WORDS, header)))
        v = X.strip(X.string(f"`{c}`"))
        said = F.when(v != "", v)
        share = lambda test: F.coalesce(F.avg(test.cast("double")), F.lit(0.0))
        each.append(
            (
                0.4 * share(said.rlike(r"^[A-Za-z][A-Za-z '\-.]+$"))
                + 0.2 * share(F.size(F.split(said, r"\s+")) <= 3)
                + 0.1 * share(said.rlike(r"^\p{Lu}"))
                + 0.1 * F.coalesce(F.count_distinct(F.lower(said)) / F.count(said), F.lit(0.0))
            ).alias(f"s{i}")
        )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.lit(base[i]) + F.col(f"s{i}")).alias("score")) for i, c in enumerate(df.columns)])
    return df.agg(*each).select(F.inline(rows))


def name_column(df: DataFrame) -> str | None:
    best = name_scores(df).orderBy(F.desc("score"), "column").first()
    return best["column"] if best and best["score"] >= CLEAR else None


def guess_gender(df: DataFrame, names: DataFrame | None, column: str | None = None) -> tuple[DataFrame, dict]:
    """Adds <column>_gender_estimate and <column>_gender_confidence; data is never overwritten.

    `names`: (name, gender M/F, share) of first names; without it the table comes back with a note.
    Estimates under MIN_CONFIDENCE stay blank.
    """
    column = column or name_column(df)
    if not column or column not in df.columns:
        return df, {"note": "No clear name column found. Name the column that holds people's names."}
    if names is None:
        return df, {"note": "No table of names given.", "column": column}
    first = F.lower(F.regexp_extract(X.clean(f"`{column}`"), r"^([^\s,]+)", 1))
    table = names.where(F.col("share") >= MIN_CONFIDENCE).select(F.lower("name").alias("__n"), F.col("gender").alias("__g"), F.col("share").cast("double").alias("__s")).groupBy("__n").agg(F.max_by("__g", "__s").alias("__g"), F.max("__s").alias("__s"))
    out = df.join(table, first == F.col("__n"), "left")
    out = out.withColumns({f"{column}_gender_estimate": F.coalesce("__g", F.lit("")), f"{column}_gender_confidence": F.col("__s")}).drop("__n", "__g", "__s")
    return out, {"column": column, "note": "Estimate from first name. Blank = unisex or unknown. Not a fact."}
