"""Gapless numbers over a whole table without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.shared import materialize


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """Adds a column `name`: first, first + 1 and on, by `order` (should be total).

    `df` is read twice, to sample its ranges and to deal it out: write it first if it is dear to make.
    Rows are dealt out by ranges of the order and numbered within each; the driver adds up one
    count for each partition.
    """
    parted = materialize(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "ranges")
    before, offsets = first - 1, []
    for pid, n in sorted(tuple(r) for r in parted.groupBy("__pid").count().collect()):
        offsets.append((pid, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "__pid int, __before long")  # one row for each partition
    own = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return parted.withColumn("__own", own).join(F.broadcast(starts), "__pid").withColumn(name, F.col("__before") + F.col("__own")).drop("__pid", "__own", "__before")
