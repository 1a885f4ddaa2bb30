"""Cells as (column, value, n) rows: the form in which exact distinct counts of many columns cost one
shuffle of distinct values. Several count(distinct) of a wide row would repeat the whole row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """(column, value, n, place): how often each column has each value as text; place is the least
    `order` of its rows (null without one). Counted within each task before anything moves.
    """
    columns = columns or df.columns
    place = F.struct(*[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)]) if order else F.lit(None).cast("int")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = df.select(place.alias("place"), cells.alias("cells")).select("place", F.inline("cells"))
    return long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("place").alias("place"))
