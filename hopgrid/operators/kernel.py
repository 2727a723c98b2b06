"""Vectorised traversal for graphs whose checked size fits every task.

The adjacency goes to the executors as one CSR (offsets, neighbours); a task advances 64 sources per
word with NumPy. The edge count is checked against MAX_EDGES first; beyond it callers use the DataFrame
traversal of `msbfs`, which has no such bound.

`hop_counts` takes any sources and sweeps all edges in every hop. `sums` and `all_hop_counts` take all
vertices as sources and search each component by itself, so that a hop costs its component only. As
distances are symmetric, they count at the vertex that is reached, by the bits that are new there. A leaf
of a larger component isn't searched from: it is one hop further than its only neighbour from all others.
`distances` leaves whole hanging trees out: what hangs from a vertex counts as often as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed edges: 64 MB as two id columns on the driver, 16 MB of neighbours in each task.
MAX_EDGES = 4_000_000
SCHEMA = "src long, hop long, n long"


def fits(edges: DataFrame, most: int = MAX_EDGES) -> bool:
    return edges.count() <= most


def hop_counts(edges: DataFrame, sources: DataFrame, tasks: int | None = None, mode: str | None = None, floor: float | None = None) -> DataFrame:
    """(src, hop, n) for sources(v). Raises if the graph is over the bound.

    With a mode and a floor, sources(v, n_vertices, n_all) are given up once their score can't reach
    the floor any more, and have no rows.
    """
    if not fits(edges):
        raise ValueError(f"more than {MAX_EDGES} edges; use the DataFrame traversal")
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(_csr(edges))
    tasks = tasks or spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, nbr = shared.value
        for rb in batches:
            own = np.searchsorted(ids, rb.column(0).to_numpy())
            for k in range(0, len(own), 64):
                sizes = [rb.column(c).to_numpy()[k : k + 64] for c in (1, 2)] if floor is not None else None
                yield _levels(ids, starts, nbr, own[k : k + 64], sizes, mode, floor)

    columns = ["v"] if floor is None else ["v", "n_vertices", "n_all"]
    return sources.select(*columns).repartition(tasks, F.xxhash64("v")).mapInArrow(run, SCHEMA)


def _csr(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first neighbour of each, neighbours by position)."""
    table = edges.select("src", "dst").toArrow()
    a, b = table["src"].to_numpy(), table["dst"].to_numpy()
    ids = np.unique(a)
    order = np.lexsort((b, a))
    return ids, np.searchsorted(a[order], ids).astype(np.int64), np.searchsorted(ids, b[order]).astype(np.int32)


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): ids from 1 in order of the smallest member, by hooking roots to the least label around them."""
    if not fits(edges):
        raise ValueError(f"more than {MAX_EDGES} edges; use star contraction")
    ids, starts, nbr = _csr(edges)
    label = _labels(starts, nbr)
    comp = np.unique(label, return_inverse=True)[1] + 1 if len(ids) else label
    table = pa.table({"v": pa.array(ids, pa.int64()), "comp": pa.array(comp, pa.int64())})
    return edges.sparkSession.createDataFrame(table, "v long, comp long")


def _labels(starts: np.ndarray, nbr: np.ndarray) -> np.ndarray:
    """The position of the smallest member of each vertex's component."""
    label = np.arange(len(starts))
    while len(starts):
        least = np.minimum(np.minimum.reduceat(label[nbr], starts), label)
        hooked = label.copy()
        np.minimum.at(hooked, label, least)
        hooked = np.minimum(hooked, least)
        hooked = hooked[hooked]
        if (hooked == label).all():
            break
        label = hooked
    return label


def _best(mode: str, sizes: list[np.ndarray], reach: np.ndarray, dist: np.ndarray, hop: int) -> np.ndarray:
    """The score that a source can still get: all it hasn't reached lies one hop further at least."""
    n, n_all = sizes
    least = np.maximum(dist + (n - 1 - reach) * (hop + 1), 1)
    return (n - 2) ** 2 / (np.maximum(n - 1, 1) * least) if mode == "component" else (n - 1) ** 2 / (np.maximum(n_all - 1, 1) * least)


def _levels(ids: np.ndarray, starts: np.ndarray, nbr: np.ndarray, own: np.ndarray, sizes: list[np.ndarray] | None = None, mode: str | None = None, floor: float | None = None) -> pa.RecordBatch:
    n = len(ids)
    reach, dist, dropped = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
    front = np.zeros(n, np.uint64)
    np.bitwise_or.at(front, own, np.uint64(1) << np.arange(len(own), dtype=np.uint64))
    seen, rows, hop = front.copy(), [], 0
    while True:
        hop += 1
        front = np.bitwise_or.reduceat(front[nbr], starts) & ~seen
        hit = front[front != 0]
        if not len(hit):
            break
        seen |= front
        bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[: len(own)]
        got = np.flatnonzero(bits)
        rows.append((ids[own[got]], np.full(len(got), hop, np.int64), bits[got]))
        if sizes is not None:
            reach, dist = reach + bits, dist + bits * hop
            out = (bits > 0) & ~dropped & (_best(mode, sizes, reach, dist, hop) < floor * (1 - 1e-9))
            if out.any():
                dropped |= out
                front &= ~np.bitwise_or.reduce(np.uint64(1) << np.flatnonzero(out).astype(np.uint64))
    if dropped.any():
        rows = [tuple(c[~np.isin(r[0], ids[own[dropped]])] for c in r) for r in rows]
    cols = [np.concatenate(c) if rows else np.zeros(0, np.int64) for c in (zip(*rows) if rows else ((), (), ()))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["src", "hop", "n"])


#: Components up to this size share packs of some PACK vertices: bit j is source j of each of them.
SMALL, PACK = 256, 16_384
#: Words of 64 sources a row in a component of its own; neighbours beyond NEAR are gathered as ranges.
WIDE, NEAR = 8, 24
SUMS = "src long, reach long, dist_sum long, ecc long"


@dataclass
class Packs:
    """The graph without the leaves of its larger components, by position: packs of components, falling degree within.

    ids, starts and nbr are the CSR; edge has each pack's first position, comp the components. slot is a source's bit within its
    component; weights has for each pack how many leaves hang from each source of a word. leaf_ids are
    the leaves of position p at leaf_at[p] to leaf_at[p + 1].
    """

    ids: np.ndarray
    starts: np.ndarray
    nbr: np.ndarray
    edge: np.ndarray
    comp: np.ndarray
    slot: np.ndarray
    weights: list[np.ndarray | None]
    leaf_ids: np.ndarray
    leaf_at: np.ndarray
    #: With whole trees for leaves: how much further a leaf's distance sum is than that of the vertex its tree hangs from.
    leaf_off: np.ndarray | None = None
    #: By position, with whole trees: the depths of all vertices in the component's trees summed, its other vertices.
    depths: np.ndarray | None = None
    others: np.ndarray | None = None
    wide: int = WIDE

    def words(self, pack: int) -> int:
        return 1 if self.weights[pack] is None else self.wide

    def blocks(self, pack: int) -> int:
        return int(self.slot[self.edge[pack] : self.edge[pack + 1]].max()) // (64 * self.words(pack)) + 1


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


#: Rounds of taking leaves off; what still hangs then is searched like the rest.
ROUNDS = 1000


def _trees(starts: np.ndarray, nbr: np.ndarray, deg: np.ndarray, large: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of (leaves, the only neighbour each has left), from outside in, of the trees that hang from the rest of large components."""
    if not len(starts):
        return []
    left, only, out = deg.copy(), np.bitwise_xor.reduceat(nbr.astype(np.int64), starts), []
    now = np.flatnonzero((left == 1) & large)
    while len(now) and len(out) < ROUNDS:
        up = only[now]
        gone = (left[up] > 1) | (now > up)  # of the last two of a tree one stays
        now, up = now[gone], up[gone]
        out.append((now, up))
        left[now] = 0
        np.subtract.at(left, up, 1)
        np.bitwise_xor.at(only, up, now)
        up = np.unique(up)
        now = up[left[up] == 1]
    return out


#: Components with more vertices than this to search from take sources that lie near each other into a word.
FAR, BALL = 1 << 16, 1024


def _near(starts: np.ndarray, nbr: np.ndarray) -> np.ndarray:
    """A place for each vertex, such that BALL vertices in a row mostly lie around one of them."""
    n, s, to = len(starts) - 1, starts.tolist(), nbr.tolist()
    done, order, stack, root = bytearray(n), [], [], 0
    while len(order) < n:
        while stack and done[stack[-1]]:
            stack.pop()
        if not stack:
            root = done.find(0, root)
        ball = [stack.pop() if stack else root]
        done[ball[0]] = 1
        room, at = BALL - len(order) % BALL, 0
        while at < len(ball) < room:
            for w in to[s[ball[at]] : s[ball[at] + 1]]:
                if not done[w]:
                    done[w] = 1
                    ball.append(w)
            at += 1
        for w in ball[room:]:
            done[w] = 0
        stack += ball[room:]
        for v in ball[at:room]:  # what lies around this ball opens later ones
            stack += [w for w in to[s[v] : s[v + 1]] if not done[w]]
        order += ball[:room]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place


def _packs(edges: DataFrame, trees: bool = False) -> Packs:
    ids, starts, nbr = _csr(edges)
    comp = np.unique(_labels(starts, nbr), return_inverse=True)[1]
    size, deg = np.bincount(comp), np.diff(np.append(starts, len(nbr)))
    if trees:
        rounds = _trees(starts, nbr, deg, size[comp] > SMALL)
        leaf, top = np.zeros(len(ids), bool), np.arange(len(ids))
        below, depth, off = np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for v, up in rounds:
            leaf[v] = True
            np.add.at(below, up, below[v])
            np.add.at(depth, up, depth[v] + below[v])
        for v, up in reversed(rounds):  # a step away from all but the vertex's own tree, a step nearer to that
            top[v], off[v] = top[up], off[up] + size[comp[v]] - 2 * below[v]
        hub, n_leaf = top[leaf], below
        left = deg - np.bincount(np.concatenate([up for _, up in rounds]), minlength=len(ids)) if rounds else deg
        depths = np.zeros(len(size), np.int64)
        np.add.at(depths, comp[~leaf], depth[~leaf])
    else:
        leaf = (deg == 1) & (size[comp] > SMALL)
        hub = nbr[starts[leaf]]  # a leaf's only neighbour
        n_leaf = np.bincount(hub, minlength=len(ids))
        left = deg - n_leaf
    order = np.lexsort((np.arange(len(size)), size))
    small = size[order] <= SMALL
    pack = np.zeros(len(size), np.int64)
    pack[order] = np.where(small, np.cumsum(size[order]) // PACK, 0)
    pack = np.unique(pack, return_inverse=True)[1]
    n_shared = int(pack[order[small]].max(initial=-1)) + 1
    pack[order[~small]] = n_shared + np.arange(int((~small).sum()))
    core = np.flatnonzero(~leaf)
    place = np.arange(len(ids))
    if trees and int(np.bincount(comp[core]).max(initial=0)) > FAR:
        ends = np.repeat(~leaf, deg) & ~leaf[nbr]
        place[core] = _near(np.append(0, np.cumsum(left[core])), (np.cumsum(~leaf) - 1)[nbr[ends]])
    at = core[np.lexsort((place[core], -left[core], pack[comp[core]]))]
    pos = np.full(len(ids), -1)
    pos[at] = np.arange(len(at))
    edge = np.searchsorted(pack[comp[at]], np.arange(len(np.unique(pack)) + 1))
    a, b = np.repeat(pos, deg), pos[nbr]
    kept = (a >= 0) & (b >= 0)
    a, b = a[kept], b[kept]
    # Sources with as many leaves fill whole words, so that a word has one weight.
    by = np.lexsort((place[core], n_leaf[core], comp[core]))
    own, weight = comp[core[by]], n_leaf[core[by]]
    first = _runs(own * (int(n_leaf.max(initial=0)) + 1) + weight)
    many = np.diff(np.append(first, len(by)))
    words = -(-many // 64)
    before = np.cumsum(words) - words
    lead = _runs(own[first])
    before -= np.repeat(before[lead], np.diff(np.append(lead, len(first))))
    slot = np.zeros(len(at), np.int32)
    slot[pos[core[by]]] = np.repeat(64 * before - first, many) + np.arange(len(by))
    weights: list[np.ndarray | None] = [None] * (len(edge) - 1)
    for i, j in zip(lead, np.append(lead[1:], len(first))):
        if size[own[first[i]]] > SMALL:
            weights[pack[own[first[i]]]] = np.repeat(weight[first[i:j]], words[i:j])
    hung = np.argsort(pos[hub], kind="stable")
    more = (off[leaf][hung], depths[comp[at]], size[comp[at]] - 1, WIDE if len(at) > 1 << 20 else 2 * WIDE) if trees else ()
    return Packs(ids[at], np.searchsorted(a[np.argsort(a, kind="stable")], np.arange(len(at) + 1)), b[np.argsort(a, kind="stable")].astype(np.int32), edge, comp[at], slot, weights, ids[leaf][hung], np.searchsorted(pos[hub][hung], np.arange(len(at) + 1)), *more)


def _pulls(g: Packs, lo: int, hi: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The k-th neighbours of all vertices that have so many, for each k below NEAR; then the rest and where each vertex's rest begins."""
    starts, n = g.starts[lo : hi + 1], np.diff(g.starts[lo : hi + 1])
    near = [g.nbr[starts[: int((n > k).sum())] + k].astype(np.int64) - lo for k in range(min(NEAR, int(n.max(initial=0))))]
    far = n[n > NEAR] - NEAR
    edge = np.cumsum(far) - far
    rest = np.repeat(starts[: len(far)] + NEAR - edge, far) + np.arange(far.sum())
    return near, g.nbr[rest].astype(np.int64) - lo, edge


#: A round of `switch` turns bottom-up and back as in `msbfs`.
ALPHA, BETA = 14, 24


def _filled(comp: np.ndarray, front: np.ndarray) -> np.ndarray:
    """For each row all sources of its component."""
    order = np.argsort(comp, kind="stable")
    first = _runs(comp[order])
    out = np.empty_like(front)
    out[order] = np.repeat(np.bitwise_or.reduceat(front[order], first, axis=0), np.diff(np.append(first, len(order))), axis=0)
    return out


class Asking:
    """Which vertices look at their neighbours in a hop of a pack; None for all.

    top_down: those that the frontier's edges lead to. bottom_up: those that still miss a source of the
    block. switch: one or the other, by the frontier's edges against those of the vertices that aren't full.
    """

    def __init__(self, g: Packs, lo: int, hi: int, direction: str):
        self.direction, self.up = direction, direction == "bottom_up"
        self.starts, self.n = g.starts[lo:hi], np.diff(g.starts[lo : hi + 1])
        self.nbr, self.lo = g.nbr, lo

    def rows(self, front: np.ndarray, seen: np.ndarray, full: np.ndarray) -> np.ndarray | None:
        if not self.direction:
            return None
        active = np.flatnonzero(front.any(axis=1))
        if self.direction == "switch":
            missing = (seen != full).any(axis=1)
            self.up = len(active) * BETA >= len(front) if self.up else self.n[active].sum() * ALPHA > self.n[missing].sum()
        if self.up:
            rows = np.flatnonzero((seen != full).any(axis=1))
        else:
            n = self.n[active]
            ends = np.repeat(self.starts[active] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            met = np.zeros(len(front), bool)
            met[self.nbr[ends] - self.lo] = True
            rows = np.flatnonzero(met)
        return rows if 2 * len(rows) < len(front) else None


def _search(g: Packs, pack: int, first: int, last: int, counted: Callable[[int, np.ndarray, np.ndarray], None], direction: str = "") -> None:
    """Search from blocks first to last of a pack; counted(hop, sources, leaves of sources) has for each vertex how many first reach it at that hop.

    Without a direction, all vertices look at their neighbours in every hop.
    """
    lo, hi, wide = int(g.edge[pack]), int(g.edge[pack + 1]), g.words(pack)
    near, rest, edge = _pulls(g, lo, hi)
    weights, slot = g.weights[pack], g.slot[lo:hi]
    exact = np.float32 if weights is None or 64 * wide * int(weights.max()) < 1 << 24 else np.float64
    got, asking = np.empty((hi - lo, wide), np.uint64), Asking(g, lo, hi, direction)
    for block in range(first, last):
        base = 64 * wide * block
        own = np.flatnonzero((slot >= base) & (slot < base + 64 * wide))
        bit = slot[own] - base
        front = np.zeros((hi - lo, wide), np.uint64)
        front[own, bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
        seen, hop = front.copy(), 0
        met = np.zeros_like(front)
        full = np.bitwise_or.reduce(front, axis=0) if weights is not None else _filled(g.comp[lo:hi], front)
        per = np.zeros((wide, 2), exact)
        per[:, 0] = 1
        if weights is not None:
            w = weights[wide * block : wide * (block + 1)]
            per[: len(w), 1] = w
        while True:
            n = np.bitwise_count(front)
            if wide == 1:
                counted(hop, n[:, 0], None)
            else:
                both = n.astype(exact) @ per
                counted(hop, both[:, 0], both[:, 1])
            hop += 1
            rows = asking.rows(front, seen, full)
            if rows is not None:
                met[:] = 0
                for k, at in enumerate(near):
                    some = rows[: np.searchsorted(rows, len(at))]  # degrees fall, so these are the first
                    if not len(some):
                        break
                    met[some] |= front[at[some]]
            for k, at in enumerate(near if rows is None else ()):
                if k:
                    np.take(front, at, axis=0, out=got[: len(at)], mode="clip")
                    np.bitwise_or(met[: len(at)], got[: len(at)], out=met[: len(at)])
                else:
                    np.take(front, at, axis=0, out=met[: len(at)], mode="clip")
            if len(rest):
                met[: len(edge)] |= np.bitwise_or.reduceat(front[rest], edge, axis=0)
            np.bitwise_or(met, seen, out=met)
            np.bitwise_xor(met, seen, out=front)
            seen, met = met, seen
            met[len(near[0]) if near else 0 :] = 0
            if not front.any():
                break


def _rows(g: Packs, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a pack, its leaves, and the local position that each leaf hangs from."""
    at = g.leaf_at[lo : hi + 1]
    return g.ids[lo:hi], g.leaf_ids[at[0] : at[-1]], np.repeat(np.arange(hi - lo), np.diff(at))


def _sums(g: Packs, pack: int, first: int, last: int, direction: str = "") -> Iterator[pa.RecordBatch]:
    lo, hi = int(g.edge[pack]), int(g.edge[pack + 1])
    reach, dist, ecc = (np.zeros(hi - lo, np.int64) for _ in range(3))

    def counted(hop: int, n: np.ndarray, more: np.ndarray | None) -> None:
        n = n.astype(np.int64) if hop else np.zeros(hi - lo, np.int64)
        every = n
        if more is not None:
            more = more.astype(np.int64)
            every = n + more
            dist[:] += more
            np.maximum(ecc, np.where(more > 0, hop + 1, 0), out=ecc)
        reach[:] += every
        dist[:] += hop * every
        np.maximum(ecc, np.where(n > 0, hop, 0), out=ecc)

    _search(g, pack, first, last, counted, direction)
    ids, leaves, hub = _rows(g, lo, hi)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, reach, dist, ecc)], names=["src", "reach", "dist_sum", "ecc"])
    if len(leaves):
        # One hop further than the hub from all but the leaf itself, which the hub counts at 1.
        far = (reach[hub], dist[hub] + reach[hub] - (first == 0), np.where(ecc[hub] > 0, ecc[hub] + 1, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (leaves, *far)], names=["src", "reach", "dist_sum", "ecc"])


def _weighed(g: Packs, pack: int, first: int, last: int) -> np.ndarray:
    """Distance sums to the vertices of a pack from those of its blocks, each as often as its tree has members.

    In a hop only those look at their neighbours that the frontier's edges lead to and that still miss a
    source of the block, unless these are most of the pack.
    """
    lo, hi, wide = int(g.edge[pack]), int(g.edge[pack + 1]), g.words(pack)
    near, rest, edge = _pulls(g, lo, hi)
    slot, n = g.slot[lo:hi], hi - lo
    weights = np.ones(g.blocks(pack)) if g.weights[pack] is None else g.weights[pack]
    exact = np.float32 if 64 * wide * int(weights.max()) < 1 << 24 else np.float64
    starts, deg = g.starts[lo:hi], np.diff(g.starts[lo : hi + 1])
    out, got, met, asked = np.zeros(n, np.int64), np.empty((n, wide), np.uint64), np.empty((n, wide), np.uint64), np.zeros(n, bool)
    for block in range(first, last):
        base = 64 * wide * block
        active = np.flatnonzero((slot >= base) & (slot < base + 64 * wide))
        bit = slot[active] - base
        front = np.zeros((n, wide), np.uint64)
        front[active, bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
        seen, hop = front.copy(), 0
        full = np.bitwise_or.reduce(front, axis=0)[None] if g.weights[pack] is not None else _filled(g.comp[lo:hi], front)
        missing = (seen != full).any(axis=1)
        w = weights[wide * block : wide * (block + 1)].astype(exact)
        per = np.concatenate([w, np.zeros(wide - len(w), exact)])
        while len(active):
            hop += 1
            k = deg[active]
            if int(k.sum()) < 2 * n:
                ends = np.repeat(starts[active] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                asked[:] = False
                asked[g.nbr[ends] - lo] = True
                rows = np.flatnonzero(asked & missing)
            else:
                rows = np.flatnonzero(missing)
            if 2 * len(rows) < n:
                new = np.zeros((len(rows), wide), np.uint64)
                for at in near:
                    some = int(np.searchsorted(rows, len(at)))  # degrees fall, so these are the first
                    if not some:
                        break
                    new[:some] |= front[at[rows[:some]]]
                some = int(np.searchsorted(rows, len(edge)))
                if some:
                    new[:some] |= np.bitwise_or.reduceat(front[rest], edge, axis=0)[rows[:some]]
                new &= ~seen[rows]
                own = new.any(axis=1)
                rows, new = rows[own], new[own]
                front[active] = 0
                front[rows] = new
                seen[rows] |= new
                missing[rows] = (seen[rows] != (full if len(full) == 1 else full[rows])).any(axis=1)
                out[rows] += hop * (np.bitwise_count(new).astype(exact) @ per).astype(np.int64)
                active = rows
            else:
                met[:] = 0
                for at in near:
                    np.take(front, at, axis=0, out=got[: len(at)], mode="clip")
                    np.bitwise_or(met[: len(at)], got[: len(at)], out=met[: len(at)])
                if len(rest):
                    met[: len(edge)] |= np.bitwise_or.reduceat(front[rest], edge, axis=0)
                np.bitwise_or(met, seen, out=met)
                np.bitwise_xor(met, seen, out=front)
                seen, met = met, seen
                found = (np.bitwise_count(front).astype(exact) @ per).astype(np.int64)
                out += hop * found
                missing = (seen != full).any(axis=1)
                active = np.flatnonzero(found)
    return out


def _distances(g: Packs, pack: int, first: int, last: int, direction: str = "") -> Iterator[pa.RecordBatch]:
    lo, hi, once = int(g.edge[pack]), int(g.edge[pack + 1]), int(first == 0)
    dist = _weighed(g, pack, first, last) + once * g.depths[lo:hi]
    reach = once * g.others[lo:hi]
    ids, leaves, hub = _rows(g, lo, hi)
    far = dist[hub] + once * g.leaf_off[g.leaf_at[lo] : g.leaf_at[hi]]
    for own in ((ids, reach, dist), (leaves, reach[hub], far)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in own], names=["src", "reach", "dist_sum"])


def _histogram(g: Packs, pack: int, first: int, last: int, direction: str = "") -> Iterator[pa.RecordBatch]:
    lo, hi = int(g.edge[pack]), int(g.edge[pack + 1])
    found: list[np.ndarray] = [np.zeros(hi - lo, np.int32)]

    def counted(hop: int, n: np.ndarray, more: np.ndarray | None) -> None:
        while len(found) < hop + 2:
            found.append(np.zeros(hi - lo, np.int32))
        if hop:
            found[hop] += n.astype(np.int32)
        if more is not None:
            found[hop + 1] += more.astype(np.int32)

    _search(g, pack, first, last, counted, direction)
    ids, leaves, hub = _rows(g, lo, hi)
    none = np.zeros(hi - lo, np.int32)
    for hop in range(1, len(found) + 1):
        own = found[hop] if hop < len(found) else none
        # A leaf is a hop further than its hub from all but itself, and one hop from the hub.
        far = (found[hop - 1][hub] if hop > 1 else np.zeros(len(hub), np.int32)) + (first == 0) * ((hop == 1) - int(hop == 2))
        for who, n in ((ids, own), (leaves, far)):
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(who[some]), pa.array(np.full(len(some), hop, np.int64)), pa.array(n[some].astype(np.int64))], names=["src", "hop", "n"])


def _all_sources(edges: DataFrame, each: Callable[..., Iterator[pa.RecordBatch]], schema: str, direction: str, trees: bool = False) -> DataFrame:
    """The rows of `each` for all packs; those with much work are dealt among tasks by blocks, whose rows are to be summed."""
    if not fits(edges):
        raise ValueError(f"more than {MAX_EDGES} edges; use the DataFrame traversal")
    spark = edges.sparkSession
    g = _packs(edges, trees)
    tasks = 4 * spark.sparkContext.defaultParallelism
    work = [(k, g.blocks(k), g.words(k) * int(g.edge[k + 1] - g.edge[k] + g.starts[g.edge[k + 1]] - g.starts[g.edge[k]])) for k in range(len(g.weights))]
    share = sum(n * cost for _, n, cost in work) / tasks
    items: list[tuple[int, int, int, int]] = []
    for pack, n, cost in work:
        step = max(1, int(share / cost))
        items += [(pack, b, min(n, b + step), cost * (min(n, b + step) - b)) for b in range(0, n, step)]
    load, dealt = [0] * tasks, [[] for _ in range(tasks)]
    for item in sorted(items, key=lambda x: -x[3]):
        least = load.index(min(load))
        load[least] += item[3]
        dealt[least].append(item[:3])
    shared = spark.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for task in rb.column(0).to_pylist():
                for item in dealt[task]:
                    yield from each(shared.value, *item, direction)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def sums(edges: DataFrame, direction: str = "") -> DataFrame:
    """(src, reach, dist_sum, ecc) for all vertices; direction: top_down, bottom_up, switch, or none of them."""
    rows = _all_sources(edges, _sums, SUMS, direction)
    return rows.groupBy("src").agg(F.sum("reach").alias("reach"), F.sum("dist_sum").alias("dist_sum"), F.max("ecc").alias("ecc"))


def distances(edges: DataFrame) -> DataFrame:
    """(src, reach, dist_sum) for all vertices."""
    rows = _all_sources(edges, _distances, "src long, reach long, dist_sum long", "", True)
    return rows.groupBy("src").agg(F.sum("reach").alias("reach"), F.sum("dist_sum").alias("dist_sum"))


def all_hop_counts(edges: DataFrame, direction: str = "") -> DataFrame:
    """`hop_counts` for all vertices; direction as in `sums`."""
    rows = _all_sources(edges, _histogram, SCHEMA, direction)
    return rows.groupBy("src", "hop").agg(F.sum("n").alias("n")).filter("n > 0")
