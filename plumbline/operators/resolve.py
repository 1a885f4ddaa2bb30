"""Entity resolution: distinct values scored against a canonical list, then mapped to the rows.

Values known by memory or equal after normalisation are settled first; only what is left meets
the Python kernel, in Arrow batches. A canonical list of over `MOST` entries is cut into parts: each
value meets each part in a row of its own, and an aggregation keeps the best. The result joins back on
the value, as Spark sees fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.functions import text as X

ACCEPT, REVIEW, FUZZY_WEIGHT, MOST = 0.88, 0.72, 0.6, 20_000
MATCH = "value string, canonical string, score double, method string, band string, alternatives array<struct<canonical: string, score: double>>"


class EntityResolver:
    """Resolves values to one of `canonical`; `memory` holds confirmed corrections, which win."""

    def __init__(self, canonical: Iterable[str], accept: float = ACCEPT, review: float = REVIEW, fuzzy_weight: float = FUZZY_WEIGHT, memory: dict[str, str] | None = None):
        self.canonical = list(dict.fromkeys(canonical))
        self.norm = {c: K.normalize(c) for c in self.canonical}
        self.exact: dict[str, str] = {}
        for c, n in self.norm.items():
            self.exact.setdefault(n, c)
        self.memory = {K.normalize(k).replace(" ", ""): v for k, v in (memory or {}).items()}
        self.accept, self.review, self.weight = accept, review, fuzzy_weight

    def resolve(self, value: str | None) -> tuple:
        """(value, canonical, score, method, band, alternatives); band is high, review or unresolved."""
        q = K.normalize(value)
        if not q:
            return value, None, 0.0, "empty", "unresolved", []
        known = self.memory.get(q.replace(" ", ""))
        if known is not None:
            return value, known, 1.0, "learned", "high", [(known, 1.0)]
        if q in self.exact:
            return value, self.exact[q], 1.0, "exact", "high", [(self.exact[q], 1.0)]
        scored = sorted(((K.entity_score(q, n, self.weight), c) for c, n in self.norm.items()), key=lambda x: -x[0])[:3]
        best, c = scored[0] if scored else (0.0, None)
        band = "high" if best >= self.accept else "review" if best >= self.review else "unresolved"
        return value, c if band != "unresolved" else None, best, "fuzzy+phonetic", band, [(c, s) for s, c in scored]


    def part(self, names: list[str]) -> EntityResolver:
        """The same resolver for some of its names."""
        out = EntityResolver(names, self.accept, self.review, self.weight)
        out.memory = self.memory
        return out


def resolve_distinct(df: DataFrame, column: str, resolver: EntityResolver, most: int = MOST) -> DataFrame:
    """One match for each distinct value of a column."""
    names = resolver.canonical
    parts = [resolver] if len(names) <= most else [resolver.part(names[a : a + most]) for a in range(0, len(names), most)]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, tuple] = {}  # by part and normalised value, within a task
        for pdf in batches:
            rows = []
            for v, p in zip(pdf["value"], pdf["part"], strict=True):
                q = p, K.normalize(v)
                if q not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[q] = parts[p].resolve(v)
                rows.append((v, *seen[q][1:], p))
            out = pd.DataFrame(rows, columns=["value", "canonical", "score", "method", "band", "alternatives", "part"])
            out["alternatives"] = [[{"canonical": c, "score": s} for c, s in a] for a in out["alternatives"]]
            yield out

    values = df.select(X.string(f"`{column}`").alias("value")).distinct().select("value", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))).alias("part"))
    found = values.mapInPandas(kernel, f"{MATCH}, part int")
    if len(parts) == 1:
        return found.drop("part")
    # what is known or equal wins; of equal scores the name that comes first in the list
    best = F.max_by(F.struct("canonical", "score", "method", "band", "alternatives"), F.struct(F.col("method") != "fuzzy+phonetic", "score", -F.col("part")))
    near = F.collect_list(F.transform("alternatives", lambda a, i: F.struct((-a["score"]).alias("s"), "part", i.alias("i"), a["canonical"].alias("c"))))
    merged = F.transform(F.slice(F.array_sort(F.flatten("near")), 1, 3), lambda a: F.struct(a["c"].alias("canonical"), (-a["s"]).alias("score")))
    out = found.groupBy("value").agg(best.alias("best"), near.alias("near"))  # three names of each part
    return out.select("value", *[f"best.{c}" for c in ("canonical", "score", "method", "band")], F.when(F.col("best.method") == "fuzzy+phonetic", merged).otherwise(F.col("best.alternatives")).alias("alternatives"))


def resolve_column(df: DataFrame, column: str, into: str, reference: str | Path | Iterable[str] | None = None, auto_accept: float = ACCEPT, review: float = REVIEW, memory: dict | None = None, source: DataFrame | None = None, **_) -> DataFrame:
    """Adds the struct <value, flagged, reason> of the resolve transform; `source`: the table `df` derives from."""
    import json

    from plumbline.functions.reference import STATE_NAMES

    if isinstance(reference, str | Path):
        reference = json.loads(Path(reference).read_text(encoding="utf-8"))["canonical"]
    resolver = EntityResolver(reference or STATE_NAMES, auto_accept, review, memory=memory)
    found = resolve_distinct(df if source is None else source, column, resolver)
    guess = F.get(F.col("alternatives"), F.lit(0))
    blank = X.strip(F.col("value")) == ""
    made = F.struct(
        F.when(blank, F.lit("")).otherwise(F.coalesce("canonical", "value")).alias("value"),
        (F.col("band") != "high").alias("flagged"),
        F.when(F.col("band") == "high", F.lit(""))
        .when(blank, F.lit("empty"))
        .when(F.col("band") == "review", F.concat(F.lit("best match "), F.col("canonical"), F.lit(", score "), F.format_number("score", 2)))
        .otherwise(F.concat(F.lit("unresolved; nearest "), F.coalesce(guess["canonical"], F.lit("none")), F.lit(", score "), F.format_number("score", 2)))
        .alias("reason"),
    )
    found = found.select(F.col("value").alias("__v"), made.alias(into))
    return df.join(found, X.string(f"`{column}`") == F.col("__v"), "left").drop("__v")


