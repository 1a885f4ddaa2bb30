from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.functions import text as X
from plumbline.operators import vocabulary
from plumbline.plans.plan import run_plan

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
texts = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=20), min_size=1, max_size=30)


@few
@given(texts)
def test_cleaners_are_idempotent(spark, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, v string")
    for f in (X.clean, X.normalize_text, X.norm_cell, X.export_safe):
        once = df.select("i", f("v").alias("v"))
        assert once.select("i", f("v").alias("v")).exceptAll(once).count() == 0


@few
@given(texts)
def test_rows_and_other_columns_survive_plans(spark, items):
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(items)], "i int, v string, w string")
    plan = {"mappings": [{"source_column": "v", "target_field": "v", "transform": t} for t in ("numeric",)] + [{"source_column": "v", "target_field": "u", "transform": "auto_categorical"}]}
    out = run_plan(df, plan).table
    assert out.select("i", "w").exceptAll(df.select("i", "w")).count() == 0 and out.count() == df.count()


@few
@given(st.lists(st.tuples(st.integers(0, 99), st.sampled_from(["years", "Years", "YEARS!"])), min_size=1, max_size=30))
def test_different_numbers_never_merge(spark, items):
    df = spark.createDataFrame([(f"{n} {w}",) for n, w in items], "v string")
    labels = vocabulary.induce_vocabulary(df, "v").select(F.regexp_extract("raw", r"(\d+)", 1).cast("int").alias("n"), "label").distinct()
    assert labels.groupBy("label").count().where("count > 1").count() == 0


@given(st.text(max_size=12), st.text(max_size=12))
def test_kernels_are_symmetric_and_bounded(a, b):
    for f in (K.ratio, K.token_sort_ratio, K.token_set_ratio):
        assert f(a, b) == f(b, a) and 0 <= f(a, b) <= 100
    assert 0 <= K.jaro_winkler(a, b) <= 1 and K.jaro_winkler(a, a) == 1
