"""A random forest that names the type of columns too messy for the rules.

Columns become 14 features, by one aggregation. The forest is trained on synthetic columns with
rising shares of junk and rescues only soft decisions, behind gates of confidence and margin.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import profile as P

FEATURES = ["num", "date", "bool", "gender", "email", "phone", "id", "distinct_ratio", "tokens", "length", "space", "cardinality", "is_01", "time"]
KINDS = ("numeric", "date", "datetime", "boolean", "gender", "email", "phone", "identifier", "name", "geo", "categorical", "free_text", "indicator")
PER_KIND, TREES, SEED, JUNK = 120, 200, 7, 0.45
CONFIDENCE, MARGIN, NUMERIC_CONFIDENCE, NUMERIC_MARGIN = 0.35, 0.20, 0.30, 0.10
SOFT = ("categorical", "free_text", "name")


def features(long: DataFrame) -> DataFrame:
    """(column, 14 features) of a long table (column, value); blanks don't count, a column of blanks is all zeros."""
    v = F.when(~X.is_missing("value"), X.strip(X.string("value")))
    low = F.lower(v)
    share = lambda t: F.coalesce(F.avg(t.cast("double")), F.lit(0.0))
    d = F.regexp_replace(v, "[^0-9]", "")
    distinct, n = F.approx_count_distinct(v, 0.01), F.count(v)
    return long.groupBy("column").agg(
        share(F.regexp_replace(v, "[,%$₦£€\\s()]", "").rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")).alias("num"),
        share(v.rlike(P.DATE)).alias("date"),
        share(low.isin(*P.YES, *P.NO)).alias("bool"),
        share(low.isin(*P.GENDERS)).alias("gender"),
        share(v.rlike(P.EMAIL)).alias("email"),
        share(d.rlike(P.PHONE)).alias("phone"),
        share(v.rlike(r"^[A-Za-z0-9]+$") & v.rlike(r"\d")).alias("id"),
        F.least(F.coalesce(distinct / n, F.lit(0.0)), F.lit(1.0)).alias("distinct_ratio"),
        F.coalesce(F.avg(F.size(F.split(v, r"\s+"))) / 6.0, F.lit(0.0)).alias("tokens"),
        F.coalesce(F.avg(F.length(v)) / 40.0, F.lit(0.0)).alias("length"),
        share(v.contains(" ")).alias("space"),
        (distinct / 25.0).alias("cardinality"),
        share(v.isin("0", "1")).alias("is_01"),
        share(v.rlike(P.TIME)).alias("time"),
    )


def column_features(df: DataFrame) -> DataFrame:
    """The features of each column of a wide table."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    return features(df.select(F.inline(rows)))


def _value(rng: random.Random, kind: str, words: list[str]) -> str:
    day = lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1950, 2024)}"
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, n)))
    return {
        "numeric": lambda: str(rng.choice([rng.randint(1, 99999), round(rng.uniform(0, 5000), 2), f"{rng.randint(1, 99)},{rng.randint(100, 999)}"])),
        "date": lambda: rng.choice([day(), f"{rng.randint(1950, 2024)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"]),
        "datetime": lambda: f"{day()} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}",
        "boolean": lambda: rng.choice(["yes", "no", "Y", "N", "true", "false"]),
        "gender": lambda: rng.choice(["M", "F", "male", "female"]),
        "email": lambda: f"{word()}@{word()}.com",
        "phone": lambda: f"0{rng.choice('789')}{rng.choice('01')}{rng.randint(10**7, 10**8 - 1)}",
        "identifier": lambda: rng.choice(["", "AB", "X"]) + str(rng.randint(10**7, 10**9)),
        "name": lambda: f"{word().title()} {word(9).title()}",
        "geo": lambda: rng.choice(P.STATE_NAMES).title(),
        "categorical": lambda: rng.choice(words),
        "free_text": lambda: " ".join(word(9) for _ in range(rng.randint(5, 14))),
        "indicator": lambda: rng.choice("01"),
    }[kind]()


def training_columns(spark: SparkSession, per_kind: int = PER_KIND, seed: int = SEED) -> DataFrame:
    """(column, label, value): synthetic columns of each kind, a share of 0 to JUNK of their values junk."""
    rng = random.Random(seed)
    rows = []
    for kind in KINDS:
        for k in range(per_kind):
            junk, words = rng.uniform(0, JUNK) if kind != "indicator" else 0.0, [f"{a}{b}" for a in ("Type ", "Class ", "") for b in rng.sample("ABCDEFGH", 3)]
            for _ in range(rng.randint(12, 40)):
                rows.append((f"{kind}:{k}", kind, rng.choice(["n/a", "?", "unknown", "x1", "see note", "-4", ""]) if rng.random() < junk else _value(rng, kind, words)))
    return spark.createDataFrame(rows, "column string, label string, value string")


def train(spark: SparkSession, per_kind: int = PER_KIND, trees: int = TREES, seed: int = SEED) -> PipelineModel:
    long = training_columns(spark, per_kind, seed)
    table = features(long).join(long.select("column", "label").distinct(), "column").cache()
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(table)
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, seed=seed, maxDepth=10)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), index.setHandleInvalid("keep"), forest, IndexToString(inputCol="prediction", outputCol="kind", labels=index.labels)]).fit(table)
    table.unpersist()
    return model


def predict(model: PipelineModel, feats: DataFrame) -> DataFrame:
    """(column, kind, probability, margin) of columns by their features."""
    out = model.transform(feats.withColumn("label", F.lit("numeric")))
    p = F.array_sort(vector_to_array("probability"))
    return out.select("column", "kind", F.element_at(p, -1).alias("probability"), (F.element_at(p, -1) - F.element_at(p, -2)).alias("margin"))


def rescue(profiles: list[P.ColumnProfile], predictions: DataFrame) -> list[P.ColumnProfile]:
    """Soft profiles replaced where the forest is sure enough; long digit strings never become numbers."""
    got = {r["column"]: r for r in predictions.collect()}  # one row a column
    out = []
    for p in profiles:
        r = got.get(p.column)
        numeric = r is not None and r["kind"] == "numeric"
        sure = r is not None and r["probability"] >= (NUMERIC_CONFIDENCE if numeric else CONFIDENCE) and r["margin"] >= (NUMERIC_MARGIN if numeric else MARGIN)
        if p.semantic_type in SOFT and sure and r["kind"] not in (p.semantic_type, "indicator") and not (numeric and p.evidence.get("id_len", 0) > 6):
            transform = {"numeric": "numeric", "date": "date_iso", "datetime": "datetime_iso", "boolean": "boolean", "gender": "gender", "email": "email", "phone": "phone_ng", "identifier": "fixed_id", "name": "name", "geo": "resolve", "categorical": "auto_categorical", "free_text": "text_normalise"}[r["kind"]]
            p = P.ColumnProfile(p.column, r["kind"], round(r["probability"], 3), transform, {}, {**p.evidence, "classifier": True})
        out.append(p)
    return out
