"""Stage tables: a DataFrame written once to the shared folder and read back.

A written table cuts the lineage, so a lost executor never costs more than the stage in work,
and what reads it twice does not run the Python before it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.functions.scratch import stage_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    path = stage_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
