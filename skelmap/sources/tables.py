"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A session that reads tables of few row groups, such as one of a single machine, may ask for their rows to be dealt out over the cores.
DEAL = "spark.skelmap.dealRows"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table folder/name.parquet, as it stands; with DEAL set to true, dealt out over as many tasks as there are cores."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get(DEAL, "false") == "true" else table
