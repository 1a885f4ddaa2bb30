"""Similar values grouped as suggestions: never merged, numbers never linked to other numbers.

Distinct values are dealt into chunks by hash, and every pair of chunks is one task, so all pairs are
met at any size. A pair that shares no word is left out only if its letters in common bound its
similarity below the threshold; all others are scored. Links then become components by joins. How
tightly a cluster hangs together takes all its pairs: they too are dealt into pairs of chunks.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.functions import text as X
from plumbline.plans.components import connected_components
from plumbline.plans.shared import materialize

LINK, GROUP, HIGH, MEDIUM, ALL_PAIRS = 0.72, 0.85, 0.88, 0.80, 1500
#: Values of a chunk: as many as make a few tasks of pairs for each core, and at most MOST_IN_CHUNK.
LEAST_IN_CHUNK, MOST_IN_CHUNK = 100, 2000
_LETTERS = {c: k for k, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}
_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?")


def guarded(a: str, b: str) -> float:
    """Similarity, but 0 for texts with different numbers."""
    if [int(n) for n in re.findall(r"\d+", a)] != [int(n) for n in re.findall(r"\d+", b)]:
        return 0.0
    x, y = a.replace(",", ""), b.replace(",", "")
    if _NUMBER.fullmatch(x) and _NUMBER.fullmatch(y) and float(x) != float(y):
        return 0.0
    return K.similarity(a, b)


def values(df: DataFrame, column: str) -> DataFrame:
    """(id, value, n): distinct non-blank values, each with a hash as its id."""
    v = df.select(X.strip(X.string(f"`{column}`")).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return v.select(F.xxhash64("value").alias("id"), "value", "n")


def _counts(texts: list[str]) -> np.ndarray:
    """How often each letter occurs in each normalised text."""
    out = np.zeros((len(texts), len(_LETTERS)), np.int32)
    for row, t in zip(out, texts, strict=True):
        for c in t:
            row[_LETTERS[c]] += 1
    return out


class _Side:
    """One chunk of values, by what bounds their similarity to others."""

    def __init__(self, pdf: pd.DataFrame):
        self.id, self.value = pdf["id"].to_numpy(np.int64), pdf["value"].tolist()
        norm = [K.normalize(v) for v in self.value]
        self.words = [set(t.split()) for t in norm]
        # the ratio of two texts is at most that of their letters: of all words, and of each word once
        self.bags = [_counts(norm), _counts([" ".join(w) for w in self.words])]
        self.sizes = [bag.sum(axis=1) for bag in self.bags]
        self.having = defaultdict(list)
        for i, words in enumerate(self.words):
            for w in words:
                self.having[w].append(i)


def _near(x: _Side, i: int, y: _Side, threshold: float) -> np.ndarray:
    """Which values of `y` may reach the threshold with value i of `x`."""
    near = np.zeros(len(y.id), bool)
    for bag, size, other, sizes in zip(x.bags, x.sizes, y.bags, y.sizes, strict=True):
        near |= 2 * np.minimum(bag[i], other).sum(axis=1) >= (threshold - 1e-9) * (size[i] + sizes)
    for w in x.words[i]:
        near[y.having.get(w, [])] = True
    return near


def links(v: DataFrame, threshold: float, score: Callable[[str, str], float]) -> DataFrame:
    """(a, b, score) of the pairs a < b of ids that reach the threshold; `score` is at most the similarity."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        x = _Side(pdf[pdf["chunk"] == lo])
        y = x if lo == hi else _Side(pdf[pdf["chunk"] == hi])
        out = []
        for i, (a, va) in enumerate(zip(x.id.tolist(), x.value, strict=True)):
            for j in np.flatnonzero(_near(x, i, y, threshold)).tolist():
                b, vb = int(y.id[j]), y.value[j]
                if lo == hi and b <= a:
                    continue
                s = score(va, vb) if a < b else score(vb, va)
                if s >= threshold:
                    out.append((min(a, b), max(a, b), s))
        return pd.DataFrame(out, columns=["a", "b", "score"]).astype({"a": "int64", "b": "int64", "score": "float64"})

    n, cores = v.count(), v.sparkSession.sparkContext.defaultParallelism
    q = max(1, math.ceil(n / min(MOST_IN_CHUNK, max(LEAST_IN_CHUNK, n // (4 * cores)))))
    pairs = q * (q + 1) // 2
    dealt = v.select("id", "value", F.pmod(F.xxhash64("id"), F.lit(q)).cast("int").alias("chunk"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    dealt = dealt.select("id", "value", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    dealt = dealt.repartition(min(pairs, max(4 * cores, pairs // 16)), "lo", "hi")  # a number of its own, so that small tasks stay apart
    return dealt.groupBy("lo", "hi").applyInPandas(kernel, "a long, b long, score double")


def _clusters(df: DataFrame, column: str, threshold: float, score: Callable[[str, str], float]) -> tuple[DataFrame, DataFrame]:
    v = materialize(values(df, column), "values")
    linked = materialize(links(v, threshold, score), "links")
    home = connected_components(linked.select("a", "b"))
    return v.join(home, F.col("id") == F.col("node")).select("component", "id", "value", "n"), linked


def group_similar(df: DataFrame, column: str, threshold: float = GROUP) -> DataFrame:
    """(representative, members, size): groups of two or more similar values; the most frequent, then longest, stands for them."""
    members, _ = _clusters(df, column, threshold, K.similarity)
    return _shown(members)


def _shown(members: DataFrame) -> DataFrame:
    """One row for each cluster, which names all its members: a cluster must fit a row."""
    rank = F.struct("n", F.length("value").alias("len"), "value")
    listed = F.transform(F.reverse(F.array_sort(F.collect_list(rank))), lambda m: m["value"])
    return members.groupBy("component").agg(F.max_by("value", rank).alias("representative"), listed.alias("members"), F.count("*").alias("size")).where("size > 1").select("representative", "members", "size", "component")


def cluster_similar(df: DataFrame, column: str, threshold: float = LINK, same: Callable[[str, str], bool | None] | None = None) -> DataFrame:
    """(representative, members, size, confidence, score): clusters by how tightly they hang together:
    high if the least similarity of any two is 0.88, medium if the mean is 0.80, else low.

    `same` may veto a pair (False): values known to name different entities.
    """

    def score(a: str, b: str) -> float:
        return 0.0 if same and same(a, b) is False else guarded(a, b)

    members, _ = _clusters(df, column, threshold, score)
    members = materialize(members, "members")
    told = cohesion(members).select("component", F.when(F.col("least") >= HIGH, "high").when(F.col("mean") >= MEDIUM, "medium").otherwise("low").alias("confidence"), F.round("mean", 3).alias("score"))
    return _shown(members).join(told, "component").select("representative", "members", "size", "confidence", "score")


def cohesion(members: DataFrame, chunk: int = MOST_IN_CHUNK) -> DataFrame:
    """(component, least, mean) of the guarded similarities of all pairs of a component's values, of which a
    task holds two chunks."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("q"))
    dealt = members.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("q")).cast("int"))
    dealt = dealt.select("component", "id", "value", "chunk", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("other"))
    dealt = dealt.select("component", "id", "value", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        x, y = (pdf[pdf["chunk"] == k].sort_values("id") for k in (lo, hi))
        least, total, n = 2.0, 0.0, 0
        for i, a in enumerate(x["value"].tolist()):
            for b in y["value"].tolist()[i + 1 if lo == hi else 0 :]:
                s = guarded(a, b)
                least, total, n = min(least, s), total + s, n + 1
        return pd.DataFrame({"component": [pdf["component"].iat[0]], "least": [least], "total": [total], "n": [n]})

    parts = dealt.groupBy("component", "lo", "hi").applyInPandas(kernel, "component long, least double, total double, n long")
    return parts.groupBy("component").agg(F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean")).where("mean is not null")
