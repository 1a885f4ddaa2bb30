"""Vocabulary induction: one label for all spellings of a category, never across numbers or words.

Works on the distinct values: they are counted, keyed and labelled by aggregations, and the labels
joined back. The join's small side is as large as the vocabulary; Spark decides how to join it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X


def induce_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(raw, n, key, label): every distinct non-blank value, trimmed, and the label of its key.

    The label is the key's most frequent spelling (ties: the longest, then the greatest), tidied.
    """
    values = df.select(X.strip(X.string(f"`{column}`")).alias("raw")).where("raw <> ''").groupBy("raw").agg(F.count("*").alias("n"))
    keyed = values.withColumn("key", X.canonical_key("raw")).where("key <> ''")
    best = keyed.groupBy("key").agg(F.max_by("raw", F.struct("n", F.length("raw"), "raw")).alias("best"))
    return keyed.join(best, "key").select("raw", "n", "key", X.label("best").alias("label"))


def categorical_column(df: DataFrame, column: str, into: str, source: DataFrame | None = None) -> DataFrame:
    """Adds the struct <value, flagged, reason> of the categorical transform; blanks are flagged.

    `source`: the table that has the column as it came, if `df` is one derived from it.
    """
    vocabulary = induce_vocabulary(df if source is None else source, column).select(F.col("raw").alias("__raw"), F.col("label").alias("__label"))
    raw = X.strip(X.string(f"`{column}`"))
    joined = df.join(vocabulary, raw == F.col("__raw"), "left")
    empty = raw == ""
    made = F.struct(F.when(empty, F.lit("")).otherwise(F.coalesce("__label", raw)).alias("value"), empty.alias("flagged"), F.when(empty, F.lit("empty category")).otherwise(F.lit("")).alias("reason"))
    return joined.withColumn(into, made).drop("__raw", "__label")
