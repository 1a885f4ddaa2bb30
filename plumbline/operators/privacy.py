"""What may leave the machine about one column: samples, masks, shapes or the header alone. Nothing is sent."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

# --- Fixed values: headers of sensitive columns. ---
SENSITIVE = r"(?i)(name|surname|first|last|phone|msisdn|email|\bnin\b|bvn|passport|account|acct|address|\bdob\b|birth|patient|client.?id)"
MODES, TASKS = ("samples", "masked", "shapes", "labels_only"), ("type", "canonical", "clean_name")
# --- End of fixed values. ---


def looks_sensitive(header: str) -> bool:
    return bool(re.search(SENSITIVE, str(header)))


def default_mode(header: str) -> str:
    return "masked" if looks_sensitive(header) else "samples"


def sample_distinct(df: DataFrame, column: str, k: int = 12, order: list[str] | None = None) -> list[str]:
    """The first k distinct non-blank values by `order`, or the least k."""
    v = X.strip(X.string(f"`{column}`"))
    place = F.min(F.struct(*[F.col(f"`{o}`") for o in order])) if order else F.lit(0)
    found = df.select(v.alias("__v"), *[f"`{o}`" for o in order or []]).where("__v <> ''").groupBy("__v").agg(place.alias("__p"))
    return [r[0] for r in found.orderBy("__p", "__v").limit(k).select("__v").collect()]


def build_column_query(df: DataFrame, column: str, task: str = "type", mode: str | None = None, k: int = 12, order: list[str] | None = None) -> dict:
    """{task, column, mode, values}: the whole of what an assistant would be shown; one column only."""
    if not isinstance(column, str) or column not in df.columns:
        raise ValueError("One existing column at a time.")
    mode = mode or default_mode(column)
    if mode not in MODES or task not in TASKS:
        raise ValueError(f"mode is one of {MODES}, task one of {TASKS}")
    values: list[str] = []
    if mode != "labels_only":
        shown = {"samples": X.strip(X.string(f"`{column}`")), "masked": X.mask(X.strip(X.string(f"`{column}`"))), "shapes": X.shape(f"`{column}`")}[mode]
        raw = sample_distinct(df, column, k, order)
        if mode == "samples":
            values = raw
        else:
            kept = df.where(X.strip(X.string(f"`{column}`")).isin(*raw)).select(shown.alias("s")).distinct() if raw else None
            values = sorted(r[0] for r in kept.collect()) if kept is not None else []  # at most k
    return {"task": task, "column": column if mode != "shapes" or not looks_sensitive(column) else "column", "mode": mode, "values": values}
