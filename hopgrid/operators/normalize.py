"""Graph normalisation, dictionary encoding, degrees and induced subgraphs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgrid.session import cut, shared_dir


def normalize(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: no self-loops, both directions of each edge, each once."""
    kept = edges.filter(F.col("src") != F.col("dst"))
    # The undirected form is deduplicated first, so half the rows reach the exchange.
    low = kept.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return low.select(F.inline(both))


def prepare(edges: DataFrame) -> DataFrame:
    """Normalised edges, dealt by src and sorted, materialised."""
    return cut(normalize(edges).repartition("src").sortWithinPartitions("src", "dst"))


#: Edges a bucket of `layout`: some 50 MB.
BUCKET_EDGES = 2_000_000


def with_degrees(edges: DataFrame) -> DataFrame:
    """(src, dst, deg): normalised edges with the degree of dst, so that a search knows the degrees of what it reaches."""
    return edges.select("src", "dst").join(degree(edges).select(F.col("v").alias("dst"), F.col("degree").alias("deg")), "dst").select("src", "dst", "deg")


def layout(edges: DataFrame) -> DataFrame:
    """`with_degrees` as a table in the shared folder, bucketed and sorted by src: a join on src shuffles these edges in no round."""
    spark = edges.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), edges.count() // BUCKET_EDGES)
    name = f"edges_{uuid.uuid4().hex}"
    dealt = with_degrees(edges).repartition(n, "src")
    dealt.write.bucketBy(n, "src").sortBy("src").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def two_hop_degree(edges: DataFrame) -> DataFrame:
    """Sum of the neighbours' degrees, with repetition."""
    d = degree(edges).withColumnRenamed("v", "dst")
    return edges.join(d, "dst").groupBy(F.col("src").alias("v")).agg(F.sum("degree").alias("n"))


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """0-based position in a total order, without gathering rows in one task.

    Rows are range-sorted, numbered within their partition, and shifted by the row counts of the
    partitions before (one number per partition reaches the driver).
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    if not starts:
        return placed.withColumn(name, F.col("_at")).drop("_at")
    shift = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return placed.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(name, F.col("_start") + within).drop("_p", "_start", "_at")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(id, internal_id): 0-based dense rank of each vertex id."""
    return with_position(vertices(edges).withColumnRenamed("v", "id"), F.col("id").asc(), name="internal_id")


def decode(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Internal ids of `column` back to external ones; an id without an entry is an error, not a lost row."""
    found = df.join(ids.select(F.col("internal_id").alias(column), F.col("id").alias("_ext")), column, "left")
    known = F.when(F.col("_ext").isNull(), F.raise_error(F.lit("unknown internal id"))).otherwise(F.col("_ext"))
    return found.withColumn(column, known).drop("_ext")


def induced_subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(v)."""
    ids = keep.select("v").distinct()
    return edges.join(ids.withColumnRenamed("v", "src"), "src", "left_semi").join(ids.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst")
