"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job relies on; anything about cluster size stays with the cluster.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Reading the Python stack for each column call takes longer than planning a wide query; errors then lack the Python line.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tickloom") -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
