"""How well the library understands labelled cases: one line a group, as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares from which on a group is good, or ok; below it is weak. (fixed values)
GOOD, OK = 0.90, 0.75


class Group(NamedTuple):
    """Cases (given, expected) and what the library answers to one that is given."""

    name: str
    cases: Iterable[tuple[Any, Any]]
    answer: Callable[[Any], Any]


def scoreboard(spark: SparkSession, groups: list[Group]) -> DataFrame:
    """(name, n, answered, right, precision, recall, accuracy, band): None is no answer, and expected of what has none."""
    rows = [(g.name, None if got is None else str(got), None if want is None else str(want)) for g in groups for given, want in g.cases for got in [g.answer(given)]]
    said, right = F.col("got").isNotNull(), F.col("got").eqNullSafe(F.col("want"))
    out = spark.createDataFrame(rows, "name string, got string, want string").groupBy("name").agg(
        F.count("*").alias("n"),
        F.count_if(said).alias("answered"),
        F.count_if(right).alias("right"),
        F.try_divide(F.count_if(said & right), F.count_if(said)).alias("precision"),
        F.try_divide(F.count_if(said & right), F.count("want")).alias("recall"),
        F.avg(right.cast("double")).alias("accuracy"),
    )
    return out.withColumn("band", F.when(F.col("accuracy") >= GOOD, "good").when(F.col("accuracy") >= OK, "ok").otherwise("weak"))
