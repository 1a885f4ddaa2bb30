import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """values([...], f): f(column) of each string, in order."""
    from pyspark.sql import functions as F

    def run(items, f):
        df = spark.createDataFrame(list(enumerate(items)), "i int, v string")
        return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]

    return run


@pytest.fixture
def transformed(spark):
    """transformed(name, [...], **params): (value, flagged, reason) of each string, in order."""
    from plumbline.plans.plan import run_plan

    def run(name, items, **params):
        df = spark.createDataFrame(list(enumerate(items)), "i int, v string")
        done = run_plan(df, {"mappings": [{"source_column": "v", "target_field": "o", "transform": name, "params": params}]})
        return [tuple(r[0]) for r in done.staged.orderBy("i").select("_t0").collect()]

    return run
