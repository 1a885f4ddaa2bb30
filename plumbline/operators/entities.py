"""What kind of entity a column holds, by a named-entity model where one is at hand.

A tagger maps texts to (label, characters of the first entity) or None. It runs in Arrow batches over distinct
values, so a value is tagged once; the labels are counted by an aggregation.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

Tagger = Callable[[list[str]], list[tuple[str, int] | None]]

# --- Fixed values: labels of the models and the column types that they stand for. ---
LABEL_TYPES = {
    "PERSON": "name", "GPE": "geo", "LOC": "geo", "FAC": "geo",
    "ORG": "organization", "MONEY": "numeric", "PERCENT": "numeric",
    "QUANTITY": "numeric", "DATE": "date", "TIME": "datetime",
}
MODELS = ("en_core_web_md", "en_core_web_lg", "en_core_web_sm")
LEAST_CHARS, LEAST_SHARE = 3, 0.6
# --- End of fixed values. ---


def installed() -> Tagger | None:
    """A tagger of the first of MODELS that is installed, loaded by each worker when it first tags."""
    model = next((m for m in MODELS if importlib.util.find_spec("spacy") and importlib.util.find_spec(m)), None)
    loaded: list = []

    def tag(texts: list[str]) -> list[tuple[str, int] | None]:
        import spacy

        if not loaded:
            loaded.append(spacy.load(model, disable=["parser", "lemmatizer"]))
        return [(d.ents[0].label_, len(d.ents[0].text)) if d.ents else None for d in loaded[0].pipe(texts)]

    return tag if model else None


def entity_type(df: DataFrame, column: str, tagger: Tagger | None = None) -> tuple[str | None, float]:
    """(column type, share): the label that most distinct non-blank values carry, where the entity makes up most
    of a value; (None, 0.0) without a tagger or any such value."""
    tagger = tagger or installed()
    if tagger is None:
        return None, 0.0
    tag = tagger

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["value"].tolist()
            whole = [f[0] if f and f[1] >= max(LEAST_CHARS, int(LEAST_SHARE * len(t))) else None for t, f in zip(texts, tag(texts), strict=True)]
            yield pd.DataFrame({"label": pd.Series(whole, dtype="object")})

    values = df.select(X.strip(X.string(f"`{column}`")).alias("value")).where("value <> ''").distinct()
    n = {r["label"]: r["count"] for r in values.mapInPandas(kernel, "label string").groupBy("label").count().collect()}  # labels, not values
    named = {label: k for label, k in n.items() if label is not None}
    if not named:
        return None, 0.0
    label = min(named, key=lambda x: (-named[x], x))
    return LABEL_TYPES.get(label), named[label] / sum(n.values())
