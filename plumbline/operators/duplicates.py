"""Duplicate rows, columns and fields.

Two rows are duplicates only if they agree in every compared column after light normalisation,
with missing markers as blank; rows without any real value never are. Groups are found and
resolved by aggregations, which combine on the map side, so a group may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.plans.long import value_counts
from plumbline.plans.ranks import numbered
from plumbline.plans.shared import materialize, spread


def _keyed(df: DataFrame, subset: list[str] | None) -> tuple[DataFrame, list[str]]:
    """`df` with two 64-bit hashes of a row's normalised cells, null for rows without any value."""
    names = {f"__c{i}": X.norm_cell(f"`{c}`") for i, c in enumerate(subset or df.columns)}
    cells = [F.col(n) for n in names]
    said = F.concat(*[F.substr(c, F.lit(1), F.lit(1)) for c in cells]) != ""
    keys = {"__k1": F.when(said, F.xxhash64(F.lit(17), *cells)), "__k2": F.when(said, F.xxhash64(*reversed(cells), F.lit(91)))}
    return spread(df).withColumns(names).withColumns(keys).drop(*names), list(keys)


def _place(df: DataFrame, order: list[str] | None) -> Column:
    """Where a row stands: by `order` and then a hash of the row, else by all columns."""
    if not order:
        return F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(df.columns)])
    return F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(order)], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("hash"))


def duplicate_groups(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """(two key hashes, size, group): the groups of two or more, numbered from 1: largest first, then by first row."""
    keyed, names = _keyed(df, subset)
    groups = keyed.where("__k1 is not null").groupBy(*names).agg(F.count("*").alias("size"), F.min(_place(df, order)).alias("__first")).where("size > 1")
    return numbered(materialize(groups, "groups"), [F.desc("size"), F.asc("__first"), *map(F.asc, names)], "group").drop("__first")


def find_duplicates(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The rows that have duplicates, with `_dup_group` (`G1 (exact)`) in front, and a summary."""
    groups = duplicate_groups(df, subset, order)
    keyed, names = _keyed(df, subset)
    found = keyed.join(groups, names).withColumn("_dup_group", F.format_string("G%d (exact)", "group"))
    totals = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return found.select("_dup_group", *[f"`{c}`" for c in df.columns]), {"duplicate_groups": totals[0], "rows_involved": totals[1]}


PREVIEWS, CUT = 50, 90


def payload(df: DataFrame, row: list[str], subset: list[str] | None = None, most: int = PREVIEWS) -> tuple[DataFrame, dict]:
    """(group, size, keep_row, keep_preview): the largest groups with the row that would stay and a short
    preview of it; and the totals over all groups. `row`: columns that name and order a row."""
    groups = duplicate_groups(df, subset, row)
    totals = groups.agg(F.count("*"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0))).first()
    keyed, names = _keyed(df, subset)
    shown = F.substring(F.concat_ws(" · ", *[F.when(X.strip(X.string(f"`{c}`")) != "", X.string(f"`{c}`")) for c in df.columns]), 1, CUT)
    place = _place(df, row)
    top = groups.where(F.col("group") <= most)
    kept = keyed.join(top, names).groupBy("group", "size").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in row]), place).alias("keep_row"), F.min_by(shown, place).alias("keep_preview"))
    return kept, {"duplicate_groups": totals[0], "removable_rows": totals[1]}


def dedupe(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order: list[str] | None = None) -> DataFrame:
    """One row of each group: the `first` or `last` by `order`, or the most `complete` (then first).

    Rows without any value in the compared columns all stay.
    """
    keyed, names = _keyed(df, subset)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    place = _place(df, order)
    if keep == "first":
        best = F.min_by(row, place)
    elif keep == "last":
        best = F.max_by(row, place)
    elif keep == "complete":
        filled = sum((F.when(X.norm_cell(f"`{c}`") != "", 1).otherwise(0) for c in df.columns), F.lit(0))
        best = F.min_by(row, F.struct((-filled).alias("gaps"), place.alias("place")))
    else:
        raise ValueError(f"keep is first, last or complete, not {keep!r}")
    kept = keyed.where("__k1 is not null").groupBy(*names).agg(best.alias("__row")).select("__row.*")
    return kept.unionByName(keyed.where("__k1 is null").select(*[f"`{c}`" for c in df.columns]))


def dedupe_file(df: DataFrame, subset: list[str] | None = None, keep: str = "first", order: list[str] | None = None) -> tuple[DataFrame, dict]:
    out = dedupe(df, subset, keep, order)
    before, after = df.count(), out.count()
    return out, {"removed": before - after, "remaining": after}


def confusion(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """(column, distinct_raw, distinct_key, variants, multi_share, warn_variants, warn_multi): columns
    whose values differ only by case or spaces, or hold several values in a cell, are poor keys."""
    each = value_counts(df, subset).where("value is not null").withColumn("key", X.strip(F.col("value")))
    multi = F.when(F.col("key").rlike("[;,/|]"), F.col("n")).otherwise(0)
    keys = each.groupBy("column", F.lower("key").alias("key")).agg(F.count("*").alias("raws"), F.sum("n").alias("n"), F.sum(multi).alias("multi"))
    out = keys.groupBy("column").agg(F.sum("raws").alias("distinct_raw"), F.count("*").alias("distinct_key"), (F.sum("multi") / F.sum("n")).alias("multi_share"))
    return out.select("column", "distinct_raw", "distinct_key", (F.col("distinct_raw") - F.col("distinct_key")).alias("variants"), "multi_share", (F.col("distinct_key") < F.col("distinct_raw")).alias("warn_variants"), (F.col("multi_share") >= 0.1).alias("warn_multi"))


def duplicate_columns(columns: list[str]) -> list[list[str]]:
    """Groups of headers that are equal without case, punctuation and a `.1` suffix."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        head, dot, tail = c.rpartition(".")
        groups.setdefault(X.header_key(head if dot and tail.isdigit() else c), []).append(c)
    return [g for g in groups.values() if len(g) > 1]


def field_overlaps(df: DataFrame, min_fill: int = 5) -> DataFrame:
    """(a, b, both, equal, overlap) for all pairs of columns with enough values, by one aggregation."""
    cols = df.columns
    filled = {c: X.strip(X.string(f"`{c}`")) for c in cols}
    fills = df.agg(*[F.sum((filled[c] != "").cast("long")).alias(f"f{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if (fills[i] or 0) >= min_fill]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, both long, equal long, overlap double")
    each = []
    for i, (a, b) in enumerate(pairs):
        both = (filled[a] != "") & (filled[b] != "")
        each.append(F.struct(F.sum(both.cast("long")).alias("both"), F.sum((both & (filled[a] == filled[b])).cast("long")).alias("equal")).alias(f"p{i}"))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}.both").alias("both"), F.col(f"p{i}.equal").alias("equal")) for i, (a, b) in enumerate(pairs)])
    out = df.agg(*each).select(F.inline(rows))
    return out.withColumn("overlap", F.when(F.col("both") > 0, F.col("equal") / F.col("both")).otherwise(0.0))


def duplicate_fields(df: DataFrame, overlap: float = 0.75, min_fill: int = 5) -> list[dict]:
    """Groups of columns that hold the same field: {columns, keep, overlap}. Kept: a real header, most values, shortest name."""
    fills = df.agg(*[F.sum((X.strip(X.string(f"`{c}`")) != "").cast("long")).alias(f"f{i}") for i, c in enumerate(df.columns)]).first()
    fill = dict(zip(df.columns, fills, strict=True))
    links = [(r["a"], r["b"], r["overlap"]) for r in field_overlaps(df, min_fill).where(F.col("overlap") >= overlap).collect()]  # columns, not rows
    home = {c: c for c in df.columns}

    def top(c: str) -> str:
        while home[c] != c:
            c = home[c]
        return c

    for a, b, _ in links:
        home[top(b)] = top(a)
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(top(c), []).append(c)
    real = lambda c: bool(X.header_key(c)) and "noheader" not in X.header_key(c)
    out = []
    for g in groups.values():
        if len(g) > 1:
            shares = [o for a, b, o in links if a in g and b in g]
            out.append({"columns": g, "keep": max(g, key=lambda c: (real(c), fill[c] or 0, -len(c))), "overlap": round(sum(shares) / len(shares), 2)})
    return out
