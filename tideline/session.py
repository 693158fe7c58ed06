"""Session defaults: UTC, Arrow transfer, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tideline", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, submit with its own master and this only adds settings."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{n}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
