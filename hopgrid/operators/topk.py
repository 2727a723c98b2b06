"""Scores per vertex, top-k, and bound-pruned top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.functions.scores import closeness_component, closeness_global
from hopgrid.operators import kernel, msbfs
from hopgrid.operators.normalize import degree, with_position
from hopgrid.session import cut

K = 7


def score_component(reach: DataFrame, components: DataFrame, stats: DataFrame) -> DataFrame:
    sized = reach.withColumnRenamed("src", "v").join(components, "v").join(stats.select("comp", "n_vertices"), "comp")
    return sized.select("v", "reach", "dist_sum", closeness_component(F.col("reach"), F.col("n_vertices"), F.col("dist_sum")).alias("closeness"))


def score_global(reach: DataFrame, n_vertices: int) -> DataFrame:
    return reach.select(F.col("src").alias("v"), "reach", "dist_sum", closeness_global(F.col("reach"), F.lit(n_vertices).cast("long"), F.col("dist_sum")).alias("closeness"))


def top_k(scores: DataFrame, k: int = K) -> DataFrame:
    """(rank, v, closeness): the k best by score, the smaller id on ties."""
    best = scores.select("v", "closeness").orderBy(F.col("closeness").desc(), F.col("v").asc()).limit(k)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("closeness")).alias("neg"), F.col("v"))))
    ranked = best.agg(rows.alias("r")).select(F.posexplode("r").alias("p", "x"))
    return ranked.select((F.col("p") + 1).cast("int").alias("rank"), F.col("x.v").alias("v"), (-F.col("x.neg")).alias("closeness"))


def pruned_top_k(
    edges: DataFrame, components: DataFrame, stats: DataFrame, k: int = K, mode: str = "component", sources: DataFrame | None = None, n: int | None = None, first_wave: int = 256, growth: int = 4, small: bool | None = None
) -> DataFrame:
    """Exact top-k of sources(v) (all vertices by default) without finishing every search.

    Sources are taken in waves of falling upper bound. A source of degree g in a component of c
    vertices has distance sum at least g + 2 (c-1-g), which bounds its score from above before it is
    searched. After each wave the k-th best score so far drops every source whose bound is below it.
    Inside the later waves it also ends searches: after hop h a source with r reached at distance sum d
    has a sum of d + (c-1-r)(h+1) at least; once that bounds its score below the k-th best, its bit
    leaves the frontier. Bounds equal to the k-th best stay, so ties are kept.
    """
    n_all = n or edges.select("src").distinct().count()
    info = components.join(stats.select("comp", "n_vertices"), "comp").join(degree(edges), "v")
    info = info if sources is None else info.join(sources.select("v"), "v", "left_semi")
    r, total = F.col("n_vertices") - 1, F.lit(n_all).cast("long")
    score = lambda dist: closeness_component(r, F.col("n_vertices"), dist) if mode == "component" else closeness_global(r, total, dist)
    least = F.col("degree") + 2 * (r - F.col("degree"))
    queue = cut(with_position(info.select("v", "n_vertices", total.alias("n_all"), score(least).alias("bound")), F.col("bound").desc(), F.col("v").asc()))
    n_queue, taken, size, best, floor = queue.count(), 0, first_wave, None, None
    small = kernel.fits(edges) if small is None else small
    while taken < n_queue:
        wave = queue.filter((F.col("position") >= taken) & (F.col("position") < taken + size))
        if best is not None and best.count() == k:
            floor = best.agg(F.min("closeness")).first()[0]
            wave = wave.filter(F.col("bound") >= F.lit(floor))
        wave = cut(wave.select("v", "n_vertices", "n_all"))
        n_wave = wave.count()
        if not n_wave:
            break  # bounds fall, so all later ones are lower still
        if small:
            reach = msbfs.reach_dist(kernel.hop_counts(edges, wave, None, mode, floor))
        else:
            go_on = None if floor is None else lambda got, dist, hop, floor=floor: score(dist + (r - got) * (hop + 1)) >= F.lit(floor * (1 - 1e-9))
            t = msbfs.traverse(edges, with_position(wave, F.col("v").asc()), n_wave, go_on=go_on)
            reach = msbfs.reach_dist(msbfs.hop_counts(t))
            reach = reach if floor is None else reach.join(t.finished.withColumnRenamed("v", "src"), "src", "left_semi")
        scored = score_component(reach, components, stats) if mode == "component" else score_global(reach, n_all)
        rows = scored.select("v", "closeness")
        best = cut((rows if best is None else rows.union(best)).orderBy(F.col("closeness").desc(), F.col("v").asc()).limit(k))
        taken, size = taken + size, size * growth
    return top_k(best, k) if best is not None else top_k(queue.select("v", F.lit(0.0).alias("closeness")), k)
