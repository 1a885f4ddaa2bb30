"""Session settings the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the UTC zone; `conf` adds to it.

    On a cluster the master and sizes come from spark-submit; `master` is for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": os.environ.get("PLUMBLINE_UI", "false"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
