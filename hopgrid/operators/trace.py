"""Run statistics: traversed edges, round tables, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def traversed_edges(sources: DataFrame, components: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: Σ over sources of their component's directed edges."""
    return sources.select("v").join(components, "v").join(stats, "comp").agg(F.coalesce(F.sum("n_edges"), F.lit(0)).cast("long").alias("n_edges"))


def round_table(spark: SparkSession, runs: list[list[dict]]) -> DataFrame:
    """(round, runs, rows, duration_ms) over the rounds of one or more traversals."""
    rows = [(r["round"], r["rows"], r["duration_ms"]) for run in runs for r in run]
    df = spark.createDataFrame(rows, "round int, rows long, duration_ms long")
    return df.groupBy("round").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"), F.sum("duration_ms").alias("duration_ms"))


def trace_lines(spark: SparkSession, traversal, n_vertices: int, n_edges: int, traversed: int, strategy: str) -> DataFrame:
    """One row a metric and round of a traversal, with the run's figures beside it.

    Metrics: TROUNDS (value: rounds), TDUR (ms of a round) and TROWS (new rows of a round). Figures:
    vertices, directed edges and traversed edges, sources a row (`batch_bits`) in `width` words of 64 bits.
    """
    total = sum(r["duration_ms"] for r in traversal.trace)
    head = (n_vertices, n_edges, traversed, 64 * traversal.words, strategy, traversal.words, total)
    rows = [("TROUNDS", 0, "", len(traversal.trace), *head)]
    for r in traversal.trace:
        rows += [("TDUR", r["round"], r["direction"], r["duration_ms"], *head), ("TROWS", r["round"], r["direction"], r["rows"], *head)]
    return spark.createDataFrame(rows, "metric string, round int, direction string, value long, n_vertices long, n_edges long, traversed_edges long, batch_bits int, strategy string, width int, total_ms long")


def run_summary(spark: SparkSession, durations: list[tuple[str, int]]) -> DataFrame:
    """(strategy, runs, mean_ms, min_ms, factor): the mean is an integer; factor is against the best strategy."""
    df = spark.createDataFrame(durations, "strategy string, ms long").groupBy("strategy").agg(
        F.count(F.lit(1)).alias("runs"), F.floor(F.sum("ms") / F.count(F.lit(1))).cast("long").alias("mean_ms"), F.min("ms").alias("min_ms")
    )
    return df.join(F.broadcast(df.agg(F.min("mean_ms").alias("best"))), F.lit(True)).select("strategy", "runs", "mean_ms", "min_ms", F.try_divide(F.col("mean_ms").cast("double"), F.col("best").cast("double")).alias("factor"))
