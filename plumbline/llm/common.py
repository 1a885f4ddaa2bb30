"""What the corpus operators share: row keys, guarded inputs and batches cut by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a batch are handled in runs of about this many bytes, whatever Arrow delivers.
RUN_BYTES = 8 << 20


#: Rows of an Arrow batch. Spark's default of 10,000 would make batches of gigabytes out of long texts.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """`df`, its session set to hand Python at most BATCH_ROWS rows at once (a lower setting stays).

    The setting is read when a lazy result is computed, so it can't be taken back here; it bounds memory
    and changes no result.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, BATCH_ROWS)
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*cols: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that name a row by its values; never null.

    Rows equal in all of `cols` share a key and so get equal results.
    """
    return F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(91), *reversed(cols))


def runs(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column `text` holds about `most` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        if col.nbytes <= most:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held + n > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
