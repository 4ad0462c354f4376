"""The session that tests, the bench and interactive use share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "sievegate", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators rely on: UTC, AQE, ANSI left on.

    On a cluster the caller's own session is used as it is; nothing in the library sets a
    configuration on it.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
