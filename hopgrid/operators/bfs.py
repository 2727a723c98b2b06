"""Scalar breadth-first search: one (src, v, d) row per reached pair, with top-down or bottom-up rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.operators.msbfs import ALPHA, BETA
from hopgrid.operators.normalize import degree, with_degrees
from hopgrid.session import cut


def _top_down(frontier: DataFrame, seen: DataFrame, edges: DataFrame) -> DataFrame:
    reached = frontier.join(edges.withColumnRenamed("src", "v"), "v").select("s", F.col("dst").alias("v")).distinct()
    return reached.join(seen.select("s", "v"), ["s", "v"], "left_anti")


def _bottom_up(frontier: DataFrame, seen: DataFrame, edges: DataFrame, universe: DataFrame) -> DataFrame:
    """An unseen vertex is reached if any neighbour is in the frontier."""
    unseen = universe.join(seen.select("s", "v"), ["s", "v"], "left_anti")
    probes = unseen.join(edges.withColumnRenamed("src", "v"), "v").select("s", "v", F.col("dst").alias("nbr"))
    return probes.join(frontier.select("s", F.col("v").alias("nbr")), ["s", "nbr"], "left_semi").select("s", "v").distinct()


def bfs_distances(edges: DataFrame, sources: DataFrame, direction: str = "top_down", components: DataFrame | None = None) -> DataFrame:
    """(src, v, d) for every v reachable from sources(v), the source at 0.

    direction: top_down, bottom_up, or switch, which turns bottom-up when the frontier's edges exceed
    a 14th of the unexplored ones, and back when the frontier is below a 24th of the vertices, both
    summed over sources. Bottom-up rounds need components(v, comp) to know the unseen pairs, which are
    put together for such a round only.
    """
    if direction not in ("top_down", "bottom_up", "switch"):
        raise ValueError(f"unknown direction: {direction}")
    edges = edges if "deg" in edges.columns or direction == "top_down" else cut(with_degrees(edges))
    hops = [cut(sources.select(F.col("v").alias("s"), "v").distinct().withColumn("d", F.lit(0).cast("long")))]
    n_all = m_open = 0
    universe = own = None
    if direction != "top_down":
        own = cut(components.join(degree(edges), "v"))
        sizes = own.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("m"))
        starts = cut(sources.select("v").distinct().join(components, "v").select(F.col("v").alias("s"), "comp"))
        universe = starts.join(components, "comp").select("s", "v")
        n_all, m_open = starts.join(sizes, "comp").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    seen, up, n_front = hops[0], False, hops[0].count()
    unfolded = [hops[0].select("s", "v")]  # what bottom-up rounds haven't taken into account yet
    while n_front:
        front = hops[-1].select("s", "v")
        if direction == "switch":
            m_front = front.join(own, "v").agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
            m_open -= m_front
            up = n_front * BETA >= n_all if up else m_front * ALPHA > max(0, m_open)
        up = up or direction == "bottom_up"
        pairs = edges.select("src", "dst")
        if up:
            unfolded = [known := cut(_all(unfolded))]
            new = _bottom_up(front, known, pairs, universe)
        else:
            new = _top_down(front, seen, pairs)
        hops.append(cut(new.withColumn("d", F.lit(len(hops)).cast("long"))))
        n_front = hops[-1].count()
        unfolded.append(hops[-1].select("s", "v"))
        # Undirected edges: what a frontier reaches is in the two hops before it or new.
        seen = hops[-1].union(hops[-2])
    return _all(hops).select(F.col("s").alias("src"), "v", "d")


def _all(hops: list[DataFrame]) -> DataFrame:
    out = hops[0]
    for h in hops[1:]:
        out = out.union(h)
    return out


def hop_counts(distances: DataFrame) -> DataFrame:
    return distances.filter("d > 0").groupBy("src", F.col("d").alias("hop")).agg(F.count(F.lit(1)).alias("n"))


def reach_dist(distances: DataFrame) -> DataFrame:
    return distances.groupBy("src").agg((F.count(F.lit(1)) - 1).alias("reach"), F.sum("d").alias("dist_sum"))
