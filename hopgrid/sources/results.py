"""Result sinks: ranked ids as one string, or as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_string(topk: DataFrame, sep: str = "|", trailing: bool = False) -> DataFrame:
    """One row: the ids of a top-k table in rank order. The table is k rows by construction."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "v")))
    joined = F.array_join(F.transform(ranked, lambda x: x["v"].cast("string")), sep)
    return topk.agg((F.concat(joined, F.lit(sep)) if trailing else joined).alias("result"))


def write_scores(scores: DataFrame, path: str, sep: str = "|") -> None:
    scores.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
