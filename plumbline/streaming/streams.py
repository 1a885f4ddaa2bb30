"""Cleaning, deduplication and quality metrics of streams.

A plan of value transforms is one projection, so it runs on a stream unchanged and without state.
Whole-column transforms need all values; a stream applies a vocabulary induced before, and
`vocabulary_sink` keeps one up to date batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from plumbline.functions import text as X
from plumbline.operators.vocabulary import induce_vocabulary
from plumbline.plans.plan import WHOLE_COLUMN, Plan, run_plan


def plan_stream(stream: DataFrame, plan: Plan | dict | str) -> DataFrame:
    """The cleaned stream, with `flagged`."""
    plan = Plan.of(plan)
    whole = [m.source_column for m in plan.mappings if m.transform in WHOLE_COLUMN]
    if whole:
        raise ValueError(f"Whole-column transforms need a vocabulary on a stream: {', '.join(whole)}")
    return run_plan(stream, plan).table


def run_plan_stream(stream: DataFrame, plan: Plan | dict | str, path: str, checkpoint: str, fmt: str = "parquet", **trigger):
    """Starts the query that writes the cleaned stream; exactly once, by its checkpoint."""
    writer = plan_stream(stream, plan).writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def dedupe_stream(stream: DataFrame, subset: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """One row of each key, by normalised cells, as long as repeats come within `delay`; state older than that goes."""
    keys = {f"__k{i}": X.norm_cell(f"`{c}`") for i, c in enumerate(subset)}
    return stream.withColumns(keys).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys)).drop(*keys)


def quality_windows(df: DataFrame, time: str, checks: dict[str, Column], window: str = "1 hour", delay: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """(window_start, by..., rows, <check> counts): tumbling windows; late rows wait `delay`. Works on batches too."""
    timed = df.withWatermark(time, delay) if df.isStreaming else df
    counts = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name) for name, c in checks.items()]
    out = timed.groupBy(F.window(time, window), *[F.col(c) for c in by or []]).agg(F.count("*").alias("rows"), *counts)
    return out.select(F.col("window.start").alias("window_start"), *(by or []), "rows", *checks)


def vocabulary_sink(column: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds each batch's value counts to a table under `path`; a repeated batch overwrites its own part."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        induce_vocabulary(batch, column).select("raw", "n").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


class Progress(StreamingQueryListener):
    """Calls `tell` with the rows and rate of each batch of a stream."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"event": "progress", "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        self.tell({"event": "idle"})

    def onQueryTerminated(self, event) -> None:
        self.tell({"event": "terminated", "error": event.exception})
