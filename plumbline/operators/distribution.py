"""Type-aware distributions of columns: numbers, categories, identifiers; before and after."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import outliers as O

BINS, TOP, CUT, MOST_COLUMNS, SAMPLE = 12, 8, 28, 8, 500


def _filled(v: Column) -> Column:
    return (v != "") & (F.lower(v) != "nan") & (v != "-")


def _text(df: DataFrame, column: str) -> Column:
    return X.strip(X.string(f"`{column}`"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, lo, hi, count): equal widths, the last bin closed, empty bins kept; one bin if all are equal."""
    x = df.select(O.number(df, column).alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends: one row
    last = F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.lit(bins - 1))
    frame = ends.select("a", "b", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    low = F.col("a") + F.col("bin") * width
    return frame.join(counts, "bin", "left").select(
        "bin",
        F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.round(low, 3)).alias("lo"),
        F.when((F.col("bin") == bins - 1) | (F.col("a") == F.col("b")), F.round("b", 3)).otherwise(F.round(low + width, 3)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def numeric_stats(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """One row: count, mean, median, min, max, q1, q3, outlier_low, outlier_high, outliers, skew."""
    x = O.number(df, column)
    one = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), O._quartiles(x, approx).alias("q"), O.skew(x).alias("skew"))
    width = F.col("q")[2] - F.col("q")[0]
    one = one.withColumns({"low": F.col("q")[0] - O.IQR_WIDTH * width, "high": F.col("q")[2] + O.IQR_WIDTH * width})
    out = df.select(x.alias("__x")).crossJoin(F.broadcast(one.select("low", "high"))).agg(F.coalesce(F.sum(((F.col("__x") < F.col("low")) | (F.col("__x") > F.col("high"))).cast("long")), F.lit(0)).alias("outliers"))  # one row
    r = lambda c, p=3: F.round(c, p)
    return one.crossJoin(out).select(
        "count", r("mean").alias("mean"), r(F.col("q")[1]).alias("median"), r("min").alias("min"), r("max").alias("max"), r(F.col("q")[0]).alias("q1"), r(F.col("q")[2]).alias("q3"),
        r("low").alias("outlier_low"), r("high").alias("outlier_high"), "outliers", r("skew", 2).alias("skew"),
    )


def category_top(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """(value, count): the most frequent values (ties by value), cut to 28 characters."""
    v = _text(df, column)
    counts = df.select(v.alias("v")).where(_filled(F.col("v"))).groupBy("v").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "v").limit(top).select(F.substring("v", 1, CUT).alias("value"), "count")


def category_profile(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """One row: distinct, filled, missing, fill_share, top_count, other."""
    v = _text(df, column)
    one = df.agg(F.count("*").alias("total"), F.count_distinct(F.when(_filled(v), v)).alias("distinct"), F.coalesce(F.sum(_filled(v).cast("long")), F.lit(0)).alias("filled"))
    best = category_top(df, column, top).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("top_count"))
    share = F.when(F.col("total") > 0, F.round(F.col("filled") / F.col("total"), 3)).otherwise(0.0)
    return one.crossJoin(best).select("distinct", "filled", (F.col("total") - F.col("filled")).alias("missing"), share.alias("fill_share"), "top_count", (F.col("filled") - F.col("top_count")).alias("other"))


def identifier_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: filled, missing, fill_share, distinct, unique_share, valid_format_share, common_length."""
    v = _text(df, column)
    ok, n = _filled(v), F.length(F.regexp_replace(v, "[^0-9]", ""))
    one = df.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("filled"), F.count_distinct(F.when(ok, v)).alias("distinct"),
        F.coalesce(F.sum((ok & n.between(7, 15)).cast("long")), F.lit(0)).alias("valid"), F.mode(F.when(ok, n), True).alias("common_length"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return one.select("filled", (F.col("total") - F.col("filled")).alias("missing"), share("filled", "total").alias("fill_share"), "distinct", share("distinct", "filled").alias("unique_share"), share("valid", "filled").alias("valid_format_share"), F.coalesce("common_length", F.lit(0)).cast("long").alias("common_length"))


def kinds(df: DataFrame, min_numeric_share: float = 0.6) -> dict[str, str]:
    """numeric, identifier or categorical for each column that has values, by one aggregation."""
    each = []
    for i, c in enumerate(df.columns):
        v = _text(df, c)
        ok = _filled(v)
        phone = v.rlike(r"^[\d\s\-+().]+$") & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 7)
        share = lambda test, ok=ok: F.avg(F.when(ok, test.cast("double")))
        each.append(F.struct(F.sum(ok.cast("long")).alias("n"), share(phone).alias("phone"), share(v.rlike(r"^0\d{2,}$")).alias("zero"), share(X.stripped_number(v).isNotNull()).alias("num"), F.approx_count_distinct(F.when(ok, v), 0.02).alias("d")).alias(f"c{i}"))  # only a kind hangs on it
    row = df.agg(*each).first()
    out = {}
    for i, c in enumerate(df.columns):
        s = row[i]
        if not s["n"]:
            continue
        if s["n"] < 5:
            out[c] = "categorical"
        elif s["phone"] >= 0.6 or s["zero"] >= 0.3:
            out[c] = "identifier"
        elif s["num"] >= min_numeric_share and s["num"] * s["n"] >= 5:
            out[c] = "numeric"
        else:
            out[c] = "identifier" if s["d"] / s["n"] >= 0.85 and s["d"] > 30 else "categorical"
    return out


def _rounded(v: float | None, places: int = 3) -> float | None:
    """As Spark rounds: half away from zero, by the decimal digits that are shown."""
    return None if v is None else float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if math.isfinite(v) else v


def _numeric_profiles(df: DataFrame, columns: list[str], bins: int) -> dict[str, dict]:
    """What `numeric_stats` and `histogram` say of each column, by two passes over the table for all of them."""
    x = [O.number(df, c) for c in columns]
    first = df.agg(*[F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), O._quartiles(v, False).alias("q"), O.skew(v).alias("skew")).alias(f"c{i}") for i, v in enumerate(x)]).first()
    cells, out = [], {}
    for i, (c, v, s) in enumerate(zip(columns, x, first, strict=True)):
        q, a, b = s["q"] or (None, None, None), s["min"], s["max"]
        low, high = (q[0] - O.IQR_WIDTH * (q[2] - q[0]), q[2] + O.IQR_WIDTH * (q[2] - q[0])) if s["q"] else (None, None)
        edges = {"mean": s["mean"], "median": q[1], "min": a, "max": b, "q1": q[0], "q3": q[2], "outlier_low": low, "outlier_high": high}
        out[c] = {"count": s["count"], **{k: _rounded(e) for k, e in edges.items()}, "outliers": 0, "skew": _rounded(s["skew"], 2), "histogram": []}
        if a is None:
            continue
        width = (b - a) / bins
        at = F.lit(0) if a == b else F.least(F.floor((v - F.lit(a)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(i).alias("i"), F.when(v.isNotNull(), at).alias("bin"), ((v < F.lit(low)) | (v > F.lit(high))).cast("long").alias("out")))
        out[c]["histogram"] = [
            {"bin": k, "lo": a if a == b else _rounded(a + k * width), "hi": _rounded(b) if k == bins - 1 or a == b else _rounded(a + k * width + width), "count": 0} for k in range(1 if a == b else bins)
        ]
    if cells:
        for r in df.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("i", "bin").agg(F.count("*").alias("n"), F.sum("out").alias("out")).collect():  # a bin a row
            one = out[columns[r["i"]]]
            one["histogram"][r["bin"]]["count"] = r["n"]
            one["outliers"] += r["out"]
    return out


def distribution_profile(df: DataFrame, most: int = MOST_COLUMNS, bins: int = BINS) -> list[dict]:
    """Chart-ready profiles of the first `most` columns that have values."""
    out, of = [], dict(list(kinds(df).items())[:most])
    numbers = [c for c, kind in of.items() if kind == "numeric"]
    numeric = _numeric_profiles(df, numbers, bins) if numbers else {}
    for c, kind in of.items():
        item = {"column": c, "kind": kind}
        if kind == "numeric":
            item |= numeric[c]
        elif kind == "identifier":
            item |= identifier_profile(df, c).first().asDict()
        else:
            item |= category_profile(df, c).first().asDict() | {"top": [r.asDict() for r in category_top(df, c).collect()]}
        out.append(item)
    return out


def before_after(before: DataFrame, after: DataFrame) -> list[dict]:
    """Profiles of both tables, paired by column name, else by position; null-safe deltas."""
    a, b = distribution_profile(before), distribution_profile(after)
    named = {x["column"]: x for x in b}
    out = []
    for i, x in enumerate(a):
        y = named.get(x["column"]) or (b[i] if i < len(b) else None)
        pair = {"column": x["column"], "before": x, "after": y}
        for k in ("count", "outliers", "filled", "distinct"):
            pair[f"{k}_change"] = (y or {}).get(k, 0) - x.get(k, 0) if k in x and y and k in y else None
        out.append(pair)
    return out
