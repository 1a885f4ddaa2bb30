"""Lexical embeddings: character 3-grams and words hashed into a fixed number of buckets; all native.

They capture spelling and shared words, not meaning. Vectors of any other source (a model's) are
compared by the same functions: `close_pairs` takes a table of them, `semantic_pairs` a function that
adds them to a table of values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.plans.shared import materialize

DIM = 256
#: Cosine from which on two values are close. (fixed value)
CLOSE = 0.62
#: Vectors of a chunk: a task holds two.
CHUNK = 4096


def grams(c: Column | str) -> Column:
    t = F.lower(X.collapse(X.string(c)))
    chars = F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.concat(chars, F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), 1))


def lexical_counts(df: DataFrame, key: str, column: str, dim: int = DIM) -> DataFrame:
    """(key, bucket, weight): the embedding's non-zero entries, normalised; the form that scales."""
    bucket = F.conv(F.substr(F.md5(F.col("gram").cast("binary")), F.lit(27), F.lit(6)), 16, 10).cast("long") % dim
    raw = df.select(F.col(f"`{key}`").alias("key"), F.explode(grams(f"`{column}`")).alias("gram")).groupBy("key", bucket.cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("w"))
    norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "key").select("key", "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def lexical_vector(c: Column | str, dim: int = DIM) -> Column:
    """The dense embedding of a text as an array of floats; zeros for a blank."""
    places = F.transform(grams(c), lambda g: (F.conv(F.substr(F.md5(g.cast("binary")), F.lit(27), F.lit(6)), 16, 10).cast("long") % dim).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(places, lambda p: p == b)).cast("double"))
    unit = lambda v, n: F.transform(v, lambda x: F.try_divide(x, n).cast("float"))
    # transforms of one element bind the counts and their norm, so that neither is computed for each entry
    return F.transform(F.array(counts), lambda v: F.transform(F.array(norm(v)), lambda n: unit(v, n))[0])[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def close_pairs(rows: DataFrame, threshold: float = CLOSE, queries: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, cosine) of all pairs of rows (id, vector) whose cosine is at least `threshold`, a < b; with
    `queries`, of each query a and each row b of another id.

    Rows are dealt into chunks by hash and every pair of chunks is one task, so no task holds more than two
    chunks, whatever the size. Null ids, null vectors, zero vectors and vectors with null or non-finite entries take no part;
    only vectors of one length are compared. Ids must be unique.
    """
    own = queries is None
    left, right = (_vectors(rows if own else queries), _vectors(rows))
    n, m = (max(1, math.ceil(d.count() / chunk)) for d in (left, right))
    home = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = left.select("id", "vector", home(n).alias("x"), every(m).alias("y"), F.lit(0).alias("side"))
    dealt = dealt.unionByName(right.select("id", "vector", every(n).alias("x"), home(m).alias("y"), F.lit(1).alias("side")))
    if own:
        dealt = dealt.where("x <= y")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out, same_chunk = [], own and pdf["x"].iat[0] == pdf["y"].iat[0]
        for _, part in pdf.groupby(pdf["vector"].str.len()):
            (i, u), (j, v) = ((p["id"].to_numpy(np.int64), np.array(p["vector"].tolist(), float)) for p in (part[part["side"] == 0], part[part["side"] == 1]))
            if not len(i) or not len(j):
                continue
            cosine = (u / np.linalg.norm(u, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
            k, l = np.nonzero(cosine >= threshold - 1e-9)  # noqa: E741
            a, b, c = i[k], j[l], cosine[k, l]
            keep = a < b if same_chunk else a != b
            a, b, c = a[keep], b[keep], c[keep]
            out.append(pd.DataFrame({"a": np.minimum(a, b) if own else a, "b": np.maximum(a, b) if own else b, "cosine": c}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    return dealt.groupBy("x", "y").applyInPandas(kernel, "a long, b long, cosine double")


def _vectors(rows: DataFrame) -> DataFrame:
    v = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where("id is not null and vector is not null").where(whole & F.exists("vector", lambda x: x != 0))


def lexical(values: DataFrame) -> DataFrame:
    """Adds `vector` to (id, value): the embedding that needs no model."""
    return values.withColumn("vector", lexical_vector("value"))


def semantic_pairs(df: DataFrame, column: str, threshold: float = CLOSE, embed: Callable[[DataFrame], DataFrame] = lexical) -> DataFrame:
    """(a, b, score): pairs of distinct non-blank values of a column that are close, a the lesser. `embed`
    adds `vector` to a table (id, value); the one at hand knows spelling and shared words, not meaning."""
    v = df.select(X.strip(X.string(f"`{column}`")).alias("value")).where("value <> ''").distinct().select(F.xxhash64("value").alias("id"), "value")
    v = materialize(embed(v), "vectors")
    found = close_pairs(v, threshold)
    name = lambda c: v.select(F.col("id").alias(c), F.col("value").alias(f"{c}_value"))
    named = found.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("a_value", "b_value").alias("a"), F.greatest("a_value", "b_value").alias("b"), F.round("cosine", 3).alias("score"))
