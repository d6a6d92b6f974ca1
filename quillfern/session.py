"""Session construction for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "quillfern", cpus: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session with UTC, AQE and as many shuffle partitions as cores."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILLFERN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
