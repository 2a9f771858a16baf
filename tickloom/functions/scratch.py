"""A fresh folder in the shared location the cluster names, for stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def stage_dir(spark: SparkSession, name: str) -> str:
    """``spark.checkpoint.dir``/name-<random>. Executors must see the same files as the driver,
    so without that setting only a local master gets a folder of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("stage tables need a folder that all executors share: set spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix=f"tickloom-{name}-") + "/data"
