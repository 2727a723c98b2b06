"""Connected components by alternating star contraction, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.operators.normalize import degree, with_position
from hopgrid.session import cut


#: From so many edges on, the least neighbours are stored before they are joined: the join is then one of
#: two plain exchanges, and Spark can split the partition of a hub.
LARGE = 1_000_000


def _large_star(e: DataFrame, large: bool) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    least = cut(least) if large else least
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame, large: bool) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    least = cut(least) if large else least
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def min_labels(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest id reachable from v, for every end of an edge(src, dst).

    Both star steps keep connectivity and only pre-aggregate (min) per vertex; neighbour lists are
    never gathered. Ends when a round leaves the edge set as it was, which is then a set of stars.
    """
    e = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct())
    before = None
    large = e.count() > LARGE
    while True:
        e = cut(_small_star(_large_star(e, large), large))
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("g")).first()
        if (row["n"], row["h"], row["g"]) == before:
            break
        before = (row["n"], row["h"], row["g"])
    roots = e.select(F.col("b").alias("v")).distinct()
    return e.select(F.col("a").alias("v"), F.col("b").alias("label")).union(roots.select("v", F.col("v").alias("label")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, comp): component ids from 1, in order of the smallest member."""
    labels = cut(min_labels(edges))
    ids = with_position(labels.select("label").distinct(), F.col("label").asc(), name="_n")
    return labels.join(ids, "label").select("v", (F.col("_n") + 1).alias("comp"))


def component_stats(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(comp, n_vertices, n_edges): edges are counted in both directions."""
    return components.join(degree(edges), "v").groupBy("comp").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"))


def component_summary(stats: DataFrame) -> DataFrame:
    """(n, max_size, n_trivial): trivial components have fewer than 5 vertices."""
    return stats.agg(F.count(F.lit(1)).alias("n"), F.max("n_vertices").alias("max_size"), F.count_if(F.col("n_vertices") < 5).alias("n_trivial"))
