"""Workload files: one `num_nodes path reference` line per data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """(num_nodes LONG, dataset STRING, reference STRING). A line without a reference is an error."""
    parts = F.split(F.trim("value"), " ", 3)
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    checked = F.when(F.size(parts) < 3, F.raise_error(F.concat(F.lit("workload line without a reference: "), F.col("value")))).otherwise(parts[2])
    return rows.select(parts[0].cast("long").alias("num_nodes"), parts[1].alias("dataset"), checked.alias("reference"))
