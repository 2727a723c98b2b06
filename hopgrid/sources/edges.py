"""Edge sources: delimited text with a header, Parquet, or any DataFrame with two id columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src LONG, dst LONG"


def read_edge_csv(spark: SparkSession, path: str, sep: str = "|", header: bool = True, extra_columns: bool = False) -> DataFrame:
    """Read `src<sep>dst` lines. A row that isn't two 64-bit ids fails the read; extra_columns lets further columns pass unread."""
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "FAILFAST")
    if not extra_columns:
        return reader.schema(EDGE_SCHEMA).option("enforceSchema", True).csv(path)
    rest = f"split(value, '\\\\Q{sep}\\\\E')"
    lines = spark.read.text(path)
    if header:
        lines = lines.filter(~F.col("value").rlike(r"^[^0-9]"))
    return lines.select(F.expr(f"cast({rest}[0] as long)").alias("src"), F.expr(f"cast({rest}[1] as long)").alias("dst"))


def read_edge_parquet(spark: SparkSession, path: str, src: str, dst: str) -> DataFrame:
    return from_frame(spark.read.parquet(path), src, dst)


def from_frame(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Two id columns as LONG edges; rows with a null end hold no edge and go."""
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).dropna()


def line_count(spark: SparkSession, path: str) -> int:
    """Lines of a text file; a last line without a newline counts."""
    return spark.read.text(path).count()


def write_edge_text(edges: DataFrame, path: str, sep: str = "|", rest: str = "") -> None:
    """Headless `src<sep>dst` lines, `rest` behind each."""
    edges.select(F.concat(F.col("src").cast("string"), F.lit(sep), F.col("dst").cast("string"), F.lit(rest))).write.text(path)
