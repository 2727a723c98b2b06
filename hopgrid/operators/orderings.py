"""Source selection and orderings. They change cost, never results; each is a total order ending in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgrid.operators.normalize import degree, two_hop_degree, vertices, with_position

SEED = "1987"


def hash_key(v: str = "v", seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.col(v).cast("string")))


def sampled_sources(edges: DataFrame, n: int | None) -> DataFrame:
    """The first n vertices in the order of a seeded hash; all of them if n is None."""
    v = vertices(edges)
    return v if n is None else v.orderBy(hash_key(), F.col("v").asc()).limit(n)


def with_batches(ordered: DataFrame, batch_bits: int) -> DataFrame:
    return ordered.withColumn("batch", F.floor(F.col("position") / F.lit(batch_bits)).cast("long"))


def order_degree(edges: DataFrame, components: DataFrame, n: int | None = None) -> DataFrame:
    """By component, then falling degree, over the (sampled) sources."""
    s = sampled_sources(edges, n).join(components, "v").join(degree(edges), "v")
    return with_position(s, F.col("comp").asc(), F.col("degree").desc(), F.col("v").asc()).select("v", "position")


def order_component(stats: DataFrame, components: DataFrame) -> DataFrame:
    """By falling component size, then component."""
    s = components.join(stats, "comp")
    return with_position(s, F.col("n_vertices").desc(), F.col("comp").asc(), F.col("v").asc()).select("v", "position")


def order_two_hop(edges: DataFrame, components: DataFrame) -> DataFrame:
    """By component, then falling sum of the neighbours' degrees."""
    s = components.join(two_hop_degree(edges), "v")
    return with_position(s, F.col("comp").asc(), F.col("n").desc(), F.col("v").asc()).select("v", "position")


def order_degree_rank(edges: DataFrame) -> DataFrame:
    """By falling degree, then id."""
    return with_position(degree(edges), F.col("degree").desc(), F.col("v").asc()).select("v", "degree", "position")


def order_neighbourhood(edges: DataFrame) -> DataFrame:
    """Heuristic for frontier sharing: a vertex follows the hub of its closed neighbourhood.

    The hub is the vertex of highest degree (smallest id on ties) among itself and its neighbours;
    vertices are ordered by falling hub degree, hub, then falling own degree. The greedy sequential
    assignment it stands for is not reproduced vertex by vertex.
    """
    d = degree(edges)
    near = edges.join(d.select(F.col("v").alias("dst"), F.col("degree").alias("d")), "dst").select(F.col("src").alias("v"), "d", F.col("dst").alias("hub"))
    own = d.select("v", F.col("degree").alias("d"), F.col("v").alias("hub"))
    hub = near.union(own).groupBy("v").agg(F.max(F.struct("d", -F.col("hub"))).alias("h"))
    s = hub.join(d, "v").select("v", "degree", F.col("h.d").alias("hub_degree"), (-F.col("h")["col2"]).alias("hub"))
    return with_position(s, F.col("hub_degree").desc(), F.col("hub").asc(), F.col("degree").desc(), F.col("v").asc()).select("v", "position")


def neighbourhood_batches(edges: DataFrame, batch_bits: int = 64) -> DataFrame:
    """(v, position, batch): batches filled in the order of `order_neighbourhood`, so that one batch takes whole neighbourhoods."""
    return with_batches(order_neighbourhood(edges), batch_bits)
