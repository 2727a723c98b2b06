"""The engine: one prepared graph, strategies by name, workloads."""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgrid.operators import bfs, components, kernel, msbfs, normalize, orderings, topk, trace
from hopgrid.session import cut, scratch, store
from hopgrid.sources.edges import read_edge_csv
from hopgrid.sources.results import result_string
from hopgrid.sources.workload import read_workload

STRATEGIES = ("auto", "kernel", "bitmask", "bottom_up", "switch", "scalar", "scalar_bottom_up", "scalar_switch", "pruned")
MODES = ("component", "global")
#: The strategies of bit masks and the direction of their rounds.
DIRECTIONS = {"bitmask": "top_down", "bottom_up": "bottom_up", "switch": "switch"}
#: Rows of (batch, vertex), 128 bytes of masks each, up to which a search from all vertices stores every round:
#: some five rows a pair in the end, so 1.5 GB. Beyond, the kernel takes it if the graph fits, else it goes in slices.
PAIRS = 2_000_000


class Graph:
    """A normalised graph with its derived tables, each computed once when first asked for."""

    def __init__(self, raw: DataFrame):
        self.spark: SparkSession = raw.sparkSession
        self.edges = normalize.prepare(raw)

    @cached_property
    def small(self) -> bool:
        """Whether the graph is within the size bound of the vectorised kernel."""
        return kernel.fits(self.edges)

    @cached_property
    def components(self) -> DataFrame:
        return cut(kernel.components(self.edges) if self.small else components.connected_components(self.edges))

    @cached_property
    def stats(self) -> DataFrame:
        return cut(components.component_stats(self.edges, self.components))

    @cached_property
    def layout(self) -> DataFrame:
        """The edges as the DataFrame searches join them, bucketed by source."""
        return normalize.layout(self.edges)

    @cached_property
    def n_vertices(self) -> int:
        return self.edges.select("src").distinct().count()

    def sources(self, limit: int | None = None) -> DataFrame:
        return orderings.sampled_sources(self.edges, limit)

    def traversal(self, limit: int | None = None, direction: str = "top_down", words: int | None = None) -> msbfs.Traversal:
        s = cut(self.sources(limit))
        return msbfs.traverse(self.layout, msbfs.ordered_sources(s), s.count(), direction, words, components=self.components if direction != "top_down" else None)

    @cached_property
    def pairs(self) -> int:
        """The (batch, vertex) rows, at the least, that a search from all vertices holds when all is reached."""
        per = F.greatest(F.lit(1.0), F.col("n_vertices") / (msbfs.MAX_WORDS * msbfs.WORD_BITS))
        return int(self.stats.agg(F.coalesce(F.sum(F.col("n_vertices") * per), F.lit(0.0))).first()[0])

    def _in_kernel(self, strategy: str, limit: int | None) -> str | None:
        """The direction in which the kernel searches from all vertices, "" for its own way, None if it doesn't.

        It also takes the bit-mask strategies over where their rounds would store more than PAIRS rows.
        """
        if limit is not None:
            return None
        if strategy in DIRECTIONS:
            return DIRECTIONS[strategy] if self.small and self.pairs > PAIRS else None
        return "" if strategy == "kernel" or strategy == "auto" and self.small else None

    def hop_counts(self, strategy: str = "auto", limit: int | None = None) -> DataFrame:
        """(src, hop, n). auto: the vectorised kernel within its size bound, else bit masks."""
        if strategy not in STRATEGIES or strategy == "pruned":
            raise ValueError(f"no such strategy for hop counts: {strategy}; known are {', '.join(s for s in STRATEGIES if s != 'pruned')}")
        direction = self._in_kernel(strategy, limit)
        if direction is not None:
            return kernel.all_hop_counts(self.edges, direction)
        if strategy == "auto":
            strategy = "kernel" if self.small else "bitmask"
        if strategy == "kernel":
            return kernel.hop_counts(self.edges, self.sources(limit))
        if strategy.startswith("scalar"):
            direction = strategy.partition("_")[2] or "top_down"
            comps = self.components if direction != "top_down" else None
            return bfs.hop_counts(bfs.bfs_distances(self.layout, self.sources(limit), direction, comps))
        if limit is None and self.pairs > PAIRS:
            return self._sliced(DIRECTIONS[strategy])
        return msbfs.hop_counts(self.traversal(limit, DIRECTIONS[strategy]))

    def _sliced(self, direction: str) -> DataFrame:
        """Hop counts from all vertices, some PAIRS rows of (batch, vertex) at a time: what a slice stored is deleted after it.

        Batches take whole components, or parts of one, so that few rows hold many sources.
        """
        ordered = cut(normalize.with_position(self.components.select("v", "comp"), F.col("comp").asc(), F.col("v").asc()).select("v", "position"))
        n, per = ordered.count(), msbfs.MAX_WORDS * msbfs.WORD_BITS
        batches = -(-n // per)
        step = per * -(-batches // -(-self.pairs // PAIRS))
        out = None
        for low in range(0, n, step):
            with scratch(self.spark):
                own = ordered.filter(F.col("position").between(low, low + step - 1))
                t = msbfs.traverse(self.layout, own, min(n - low, step), direction, components=self.components if direction != "top_down" else None, keep=store)
                part = cut(msbfs.hop_counts(t))
            out = part if out is None else out.union(part)
            self.spark._jvm.System.gc()  # Spark deletes shuffle files once their plans are collected
        return out

    def reach(self, strategy: str = "auto", limit: int | None = None) -> DataFrame:
        direction = self._in_kernel(strategy, limit)
        if direction is not None:
            return kernel.sums(self.edges, direction).drop("ecc") if direction else kernel.distances(self.edges)
        return msbfs.reach_dist(self.hop_counts(strategy, limit))

    def eccentricity(self, strategy: str = "auto", limit: int | None = None) -> DataFrame:
        direction = self._in_kernel(strategy, limit)
        if direction is not None:
            return kernel.sums(self.edges, direction).select(F.col("src").alias("v"), "ecc")
        return msbfs.eccentricity(self.hop_counts(strategy, limit))

    def closeness(self, mode: str = "component", strategy: str = "auto", limit: int | None = None, n: int | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}; known are {', '.join(MODES)}")
        reach = self.reach(strategy, limit)
        if mode == "component":
            return topk.score_component(reach, self.components, self.stats)
        return topk.score_global(reach, n or self.n_vertices)

    def top_k(self, k: int = topk.K, mode: str = "component", strategy: str = "auto", limit: int | None = None, n: int | None = None) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"unknown mode: {mode}; known are {', '.join(MODES)}")
        if strategy == "pruned":
            return topk.pruned_top_k(self.edges if self.small else self.layout, self.components, self.stats, k, mode, None if limit is None else self.sources(limit), n or self.n_vertices, small=self.small)
        return topk.top_k(self.closeness(mode, strategy, limit, n), k)


def run_workload(spark: SparkSession, path: str, runs: int = 1, strategies: tuple[str, ...] = ("auto",), mode: str = "component", limit: int | None = None) -> list[dict]:
    """Run every data set of a workload file; load, components and traversal are timed apart, and each full answer is checked."""
    unknown = [x for x in strategies if x not in STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}; known are {', '.join(STRATEGIES)}")
    report = []
    for line in read_workload(spark, path).collect():
        began = time.perf_counter()
        graph = Graph(read_edge_csv(spark, line["dataset"]))
        loaded = time.perf_counter()
        graph.stats.count()
        analysed = time.perf_counter()
        for strategy in strategies:
            for _ in range(runs):
                start = time.perf_counter()
                answer = result_string(graph.top_k(mode=mode, strategy=strategy, limit=limit, n=line["num_nodes"] if mode == "global" else None)).first()[0]
                report.append({"dataset": line["dataset"], "strategy": strategy, "ms": int(1000 * (time.perf_counter() - start)), "load_ms": int(1000 * (loaded - began)), "components_ms": int(1000 * (analysed - loaded)), "answer": answer, "correct": answer == line["reference"] if limit is None else None})
    return report



def summary(spark: SparkSession, report: list[dict]) -> DataFrame:
    """(dataset, strategy, runs, mean_ms, min_ms, factor, correct) of a report: factor is against the data set's best strategy."""
    out = None
    for dataset in dict.fromkeys(r["dataset"] for r in report):
        own = [r for r in report if r["dataset"] == dataset]
        wrong = {r["strategy"] for r in own if r["correct"] is False}
        rows = trace.run_summary(spark, [(r["strategy"], r["ms"]) for r in own])
        rows = rows.select(F.lit(dataset).alias("dataset"), "*", (~F.col("strategy").isin(sorted(wrong)) if wrong else F.lit(True)).alias("correct"))
        out = rows if out is None else out.union(rows)
    return out
