"""Multi-source bit-parallel search.

Sources are dealt into batches of 64*words; bit i of word k says "source k*64+i of the batch". One
round moves every batch one hop:

    frontier ⋈ edges  →  bit_or per (batch, dst)  →  minus the last two frontiers

Edges are undirected, so what a source's frontier reaches is new to it, or in its last two frontiers:
no round touches the vertices of earlier ones, and each round writes its new rows only. All batches
travel in one DataFrame, so hops are paid once and not per source; `bit_or` combines before the
exchange, which also flattens hubs. The driver sees a round's counts and nothing else.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgrid.functions.bits import WORD_BITS, and_not, any_set, bit, popcount
from hopgrid.operators.normalize import degree, with_degrees, with_position
from hopgrid.session import cut

MAX_WORDS = 16
#: A top-down round turns bottom-up when the frontier's edges exceed a 14th of the unexplored ones,
#: and back when the frontier is below a 24th of the vertices. Fixed values.
ALPHA, BETA = 14, 24
#: Batches whose masks of live sources are broadcast (128 bytes each at most); more are joined by an exchange.
MAX_BATCHES = 65_536


@dataclass
class Traversal:
    """discovered(batch, v, hop, w0..): the sources that first reach v at that hop. sources(v, batch, word, bit).

    finished(v): the sources whose search wasn't given up.
    """

    discovered: DataFrame
    sources: DataFrame
    words: int
    trace: list[dict] = field(default_factory=list)
    finished: DataFrame | None = None


def deal(ordered: DataFrame, words: int) -> DataFrame:
    """(v, batch, word, bit) from (v, position), with further columns as they are."""
    per = WORD_BITS * words
    return ordered.select(
        "v",
        F.floor(F.col("position") / per).cast("long").alias("batch"),
        F.floor(F.col("position") % per / WORD_BITS).cast("int").alias("word"),
        (F.col("position") % WORD_BITS).cast("int").alias("bit"),
        *[c for c in ordered.columns if c not in ("v", "position", "batch", "word", "bit")],
    )


def _names(words: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{k}" for k in range(words)]


def _masks(words: int, prefix: str = "w") -> list[Column]:
    """Aggregates that set the bits of sources(word, bit)."""
    zero = F.lit(0).cast("long")
    return [F.bit_or(F.when(F.col("word") == k, bit(F.col("bit"))).otherwise(zero)).alias(f"{prefix}{k}") for k in range(words)]


def expand_down(front: DataFrame, before: DataFrame, edges: DataFrame, words: list[str]) -> DataFrame:
    """(batch, v, deg, w..): what the frontier reaches, less the last two frontiers. edges has (src, dst, deg of dst)."""
    zero = F.lit(0).cast("long")
    old = [f"s{k}" for k in range(len(words))]
    moved = front.select("batch", F.col("v").alias("src"), *words).join(edges, "src").select("batch", F.col("dst").alias("v"), "deg", *words, *[zero.alias(s) for s in old])
    known = front.union(before).select("batch", "v", "deg", *[zero.alias(w) for w in words], *[F.col(w).alias(s) for w, s in zip(words, old)])
    met = moved.union(known).groupBy("batch", "v").agg(F.max("deg").alias("deg"), *[F.bit_or(c).alias(c) for c in (*words, *old)])
    # Rows are picked before and in other terms than the new words are made: a condition over aliases of
    # many words would be inferred again for every choice of them when Catalyst collects constraints.
    some = _any([F.col(w).bitwiseOR(F.col(s)) != F.col(s) for w, s in zip(words, old)])
    return met.filter(some).select("batch", "v", "deg", *[and_not(F.col(w), F.col(s)).alias(w) for w, s in zip(words, old)])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def expand_up(front: DataFrame, seen: DataFrame, members: DataFrame, full: DataFrame, edges: DataFrame, words: list[str]) -> DataFrame:
    """The same asked from the other side: rows of members(batch, v, deg) that still miss sources ask their neighbours for the frontier's masks.

    The members are met with what they have seen, one row (batch, v) each, for this round only.
    """
    zero = F.lit(0).cast("long")
    state = members.join(seen, ["batch", "v"], "left").join(full, "batch")
    has = [F.coalesce(F.col(w), zero) for w in words]
    open_ = state.filter(_any([F.col(f"f{k}").bitwiseOR(h) != h for k, h in enumerate(has)]))
    open_ = open_.select("batch", "v", "deg", *[and_not(F.col(f"f{k}"), h).alias(f"m{k}") for k, h in enumerate(has)])
    asks = open_.withColumnRenamed("v", "src").join(edges.select("src", "dst"), "src").withColumnRenamed("dst", "nbr")
    got = asks.join(front.select("batch", F.col("v").alias("nbr"), *words), ["batch", "nbr"])
    gains = [F.bit_or(F.col(w).bitwiseAND(F.col(f"m{k}"))).alias(w) for k, w in enumerate(words)]
    fresh = got.groupBy("batch", F.col("src").alias("v")).agg(F.max("deg").alias("deg"), *gains)
    return fresh.filter(any_set([F.col(w) for w in words]))


#: Tells after a hop which sources go on: (reached so far, distance sum so far, hop) → true column; the sources' further columns are there too.
GoOn = Callable[[Column, Column, int], Column]


def traverse(
    edges: DataFrame,
    ordered: DataFrame,
    n_sources: int,
    direction: str = "top_down",
    words: int | None = None,
    max_hops: int | None = None,
    components: DataFrame | None = None,
    go_on: GoOn | None = None,
    keep: Callable[[DataFrame], DataFrame] = cut,
) -> Traversal:
    """Search from all sources of ordered(v, position, ...) at once, to the fixpoint.

    direction: top_down, bottom_up, or switch, which weighs the frontier's edges against the
    unexplored ones, summed over sources. words: 64-source words per row (by default as many as the
    sources fill, 16 at most). Bottom-up rounds need components(v, comp) to know what is reachable.
    keep stores a round's rows. go_on is asked after each hop; sources that it drops leave the frontier, and so does all that only
    they would reach.
    """
    if direction not in ("top_down", "bottom_up", "switch"):
        raise ValueError(f"unknown direction: {direction}")
    words = words or max(1, min(MAX_WORDS, -(-n_sources // WORD_BITS)))
    names = _names(words)
    edges = edges if "deg" in edges.columns else cut(with_degrees(edges))
    sources = cut(deal(ordered, words))
    own = degree(edges).withColumnRenamed("degree", "deg")
    front = cut(sources.join(own, "v").groupBy("batch", "v").agg(F.max("deg").alias("deg"), *_masks(words)))
    before = front.limit(0)
    out, trace, up = [front], [], False
    unfolded: list[DataFrame] = [front]  # what bottom-up rounds haven't taken into account yet
    m_all = n_all = 0
    if direction != "top_down":
        info = cut(components.join(own, "v"))
        sizes = info.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("deg").alias("m"))
        members = cut(sources.join(info, "v").select("batch", "comp").distinct()).join(info, "comp").select("batch", "v", "deg")
        full = cut(sources.groupBy("batch").agg(*_masks(words, "f")))
        n_all, m_all = sources.join(info, "v").join(sizes, "comp").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    bits = popcount([F.col(w) for w in names]).cast("long")
    count = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).alias("n"), F.coalesce(F.sum(bits * F.col("deg")), F.lit(0)).alias("m")]
    found = front.agg(*count).first()
    m_open, live = m_all - found["m"], None
    if go_on:
        live = sources.withColumns({"reach": F.lit(0).cast("long"), "dist_sum": F.lit(0).cast("long")})
    while found["rows"] and (max_hops is None or len(trace) < max_hops):
        began = time.perf_counter()
        if direction == "switch":
            up = found["n"] * BETA >= n_all if up else found["m"] * ALPHA > max(0, m_open)
        up = up or direction == "bottom_up"
        if up:
            seen = _union([x.select("batch", "v", *names) for x in unfolded]).groupBy("batch", "v").agg(*[F.bit_or(w).alias(w) for w in names])
            unfolded = [seen := keep(seen)]
            fresh = keep(expand_up(front, seen, members, full, edges, names))
        else:
            fresh = keep(expand_down(front, before, edges, names))
        if go_on:
            fresh, live = _abort(fresh, live, go_on, len(out), words)
        before, front = front, fresh
        found = front.agg(*count).first()
        m_open -= found["m"]
        if found["rows"]:
            out.append(front)
            unfolded.append(front)
        trace.append({"round": len(trace) + 1, "rows": found["rows"], "direction": "up" if up else "down", "duration_ms": int(1000 * (time.perf_counter() - began))})
    discovered = _union([x.withColumn("hop", F.lit(k).cast("long")) for k, x in enumerate(out)]).drop("deg")
    return Traversal(discovered, sources, words, trace, live.select("v") if go_on else None)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _abort(fresh: DataFrame, live: DataFrame, go_on: GoOn, hop: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The new rows without the sources that are given up, and the live sources with their sums. Sources that found nothing new are done and stay live."""
    names = _names(words)
    n = _bit_counts(fresh, [], words).withColumnRenamed("n", "more")
    sums = live.join(n, ["batch", "word", "bit"], "left").withColumn("more", F.coalesce("more", F.lit(0).cast("long")))
    sums = sums.withColumns({"reach": F.col("reach") + F.col("more"), "dist_sum": F.col("dist_sum") + F.col("more") * hop})
    live = cut(sums.filter((F.col("more") == 0) | go_on(F.col("reach"), F.col("dist_sum"), hop)).drop("more"))
    masks = cut(live.groupBy("batch").agg(*_masks(words, "a")))
    masks = F.broadcast(masks) if masks.count() <= MAX_BATCHES else masks
    met = fresh.join(masks, "batch")
    some = _any([and_not(F.col(w), F.col(f"a{k}")) != F.col(w) for k, w in enumerate(names)])
    return cut(met.filter(some).select("batch", "v", "deg", *[F.col(w).bitwiseAND(F.col(f"a{k}")).alias(w) for k, w in enumerate(names)])), live


def _bit_counts(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """(batch, word, bit, keys, n): rows per source. 64 bit sums per word, pre-aggregated, then turned into rows."""
    per_word = rows.select("batch", *keys, F.posexplode(F.array(*_names(words))).alias("word", "w")).filter("w <> 0")
    sums = [F.sum(F.call_function("getbit", F.col("w"), F.lit(j)).cast("long")).alias(f"b{j}") for j in range(WORD_BITS)]
    wide = per_word.groupBy("batch", "word", *keys).agg(*sums)
    return wide.select("batch", "word", *keys, F.posexplode(F.array(*[f"b{j}" for j in range(WORD_BITS)])).alias("bit", "n")).filter("n > 0")


def hop_counts(t: Traversal) -> DataFrame:
    """(src, hop, n): vertices first reached at each hop."""
    tall = _bit_counts(t.discovered.filter("hop > 0"), ["hop"], t.words)
    return tall.join(t.sources.select("v", "batch", "word", "bit"), ["batch", "word", "bit"]).select(F.col("v").alias("src"), "hop", "n")


def reach_dist(counts: DataFrame) -> DataFrame:
    return counts.groupBy("src").agg(F.sum("n").alias("reach"), F.sum(F.col("n") * F.col("hop")).alias("dist_sum"))


def eccentricity(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("src").alias("v")).agg(F.max("hop").alias("ecc"))


def frontier_sharing(t: Traversal) -> DataFrame:
    """(round, bits, n): how many (batch, vertex) rows a hop newly reaches with that many sources."""
    bits = popcount([F.col(w) for w in _names(t.words)])
    return t.discovered.filter("hop > 0").select(F.col("hop").alias("round"), bits.cast("long").alias("bits")).groupBy("round", "bits").agg(F.count(F.lit(1)).alias("n"))


def edge_sharing(t: Traversal, edges: DataFrame) -> DataFrame:
    """(round, bits, n): over the edges that a hop takes, how many sources first reach the end through it (ties count for each edge)."""
    names = _names(t.words)
    ends = t.discovered.select("batch", F.col("v").alias("dst"), (F.col("hop") - 1).alias("hop"), *[F.col(w).alias(f"e{k}") for k, w in enumerate(names)])
    taken = t.discovered.join(edges.select("src", "dst"), F.col("v") == F.col("src")).join(ends, ["batch", "dst", "hop"])
    bits = popcount([F.col(w).bitwiseAND(F.col(f"e{k}")) for k, w in enumerate(names)])
    return taken.select((F.col("hop") + 1).alias("round"), bits.cast("long").alias("bits")).filter("bits > 0").groupBy("round", "bits").agg(F.count(F.lit(1)).alias("n"))


def batch_usage(t: Traversal) -> DataFrame:
    """(batch, steps, mean_bits): hops a batch takes, and how many of its sources a newly reached row holds on average."""
    rows = t.discovered.filter("hop > 0").select("batch", "hop", popcount([F.col(w) for w in _names(t.words)]).alias("bits"))
    return rows.groupBy("batch").agg(F.max("hop").alias("steps"), (F.sum("bits").cast("double") / F.count(F.lit(1)).cast("double")).alias("mean_bits"))


def distance_identity(counts: DataFrame) -> DataFrame:
    """(src, d1, d2): the distance sum, and the same as Σ_h #{v : d(v) > h} from the hop counts."""
    totals = counts.groupBy("src").agg(F.sum("n").alias("r"), F.max("hop").alias("m"), F.sum(F.col("n") * F.col("hop")).alias("d1"))
    steps = totals.select("src", "r", "d1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("h"))
    upto = steps.join(counts.select("src", "hop", "n"), (steps["src"] == counts["src"]) & (F.col("hop") <= F.col("h")), "left").select(steps["src"], "r", "d1", "h", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    left = upto.groupBy("src", "r", "d1", "h").agg((F.col("r") - F.sum("n")).alias("rest"))
    return left.groupBy("src", "d1").agg(F.sum("rest").alias("d2"))


def ordered_sources(df: DataFrame) -> DataFrame:
    return with_position(df.select("v"), F.col("v").asc())
