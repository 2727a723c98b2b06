"""Repeated byte strings by suffix sorting: deep-shallow sorting of the windows that can repeat.

`repeats` finds which windows share an anchor but not all of their surroundings; these are sorted
here. Multikey quicksort runs to a shallow depth, on 8-byte characters, and only inside groups that
are still tied. Groups with a longer common prefix are ordered by blind tries: one member is the
trie's path; for each other member only the first branching place on that path is found and stored,
members that branch at the same place with the same character form the subtrie below, and those that
never branch are equal over the whole window. All tries of a batch grow together, a level a pass.

Defined cases: null is an empty text; texts under 200 bytes lose nothing by themselves but count as
nothing either (no window fits); equal rows remove each other; results are per row; matches never
cross texts; bytes are those of UTF-8, so a removed span may split a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopgrid.llm import repeats
from hopgrid.llm.repeats import Kind, covered
from hopgrid.llm.text import bounds

BYTES = Kind(words=False, size=200, grams=(32, 96, 160, 200), batch=150_000)
DIGIT = 8
SHALLOW = 3  # 8-byte characters


def characters(buf: np.ndarray) -> np.ndarray:
    """Big-endian value of the 8 bytes from each position."""
    padded = np.concatenate([buf, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for k in range(DIGIT):
        out = out << np.uint64(8) | padded[k : k + len(buf)]
    return out


def _ties(*keys: np.ndarray) -> np.ndarray:
    """Running number of equal neighbours in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _tied(tie: np.ndarray) -> np.ndarray:
    """Which rows of a running number aren't alone."""
    same = np.zeros(len(tie), bool)
    same[1:] = tie[1:] == tie[:-1]
    same[:-1] |= same[1:]
    return same


def deep_shallow(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tie): the windows buf[start:start+size] sorted within their groups, and running numbers of equal ones.

    size is a multiple of 8.
    """
    chars, depth = characters(buf), size // DIGIT
    order = np.lexsort((chars[starts], group))
    tie = _ties(group[order], chars[starts[order]])
    todo = np.flatnonzero(_tied(tie))
    for d in range(1, min(SHALLOW, depth)):
        own, key = order[todo], tie[todo]
        c = chars[starts[own] + d * DIGIT]
        by = np.lexsort((c, key))
        order[todo], c = own[by], c[by]
        new = _ties(key, c)
        todo, tie = _renumber(tie, todo, new)
    from_ = np.full(len(order), min(SHALLOW, depth))
    while len(todo):
        own, key = order[todo], tie[todo]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        path = starts[own[first]][which]  # the member that is each trie's path
        at, mine = np.full(len(own), depth), starts[own]
        live = np.arange(len(own))
        for d in range(int(from_[todo].min()), depth):
            live = live[at[live] == depth]
            if not len(live):
                break
            off = live[(chars[mine[live] + d * DIGIT] != chars[path[live] + d * DIGIT]) & (from_[todo[live]] <= d)]
            at[off] = d
        branch = at < depth
        c = np.where(branch, chars[mine + np.minimum(at, depth - 1) * DIGIT], np.uint64(0))
        below = branch & (c < chars[path + np.minimum(at, depth - 1) * DIGIT])
        # Left of the path: branching earlier is smaller; right of it: branching later is smaller.
        place = np.where(below, at - depth, np.where(branch, depth - at, 0))
        by = np.lexsort((c, place, key))
        order[todo] = own[by]
        place, c, at = place[by], c[by], at[by]
        new = _ties(key, place, c)
        from_[todo] = at + 1
        open_ = todo[place != 0]  # equal to the path: done
        _, tie = _renumber(tie, todo, new)
        todo = open_[_tied(tie[open_])]
    return order, tie


def _renumber(tie: np.ndarray, rows: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split ties by the finer numbers of some rows; gives the rows that are still tied, and the numbers."""
    fine = np.zeros(len(tie), np.int64)
    fine[rows] = new + 1
    out = _ties(tie, fine)
    return rows[_tied(out)[rows]], out


def solve(group: np.ndarray, n_occ: np.ndarray, windows: np.ndarray, hulls: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(hulls), np.uint8)
    hull = np.repeat(np.arange(len(hulls)), windows)
    offs = bounds(np.array([len(x) for x in hulls], np.int64))
    starts = offs[hull] + np.arange(len(hull)) - np.repeat(bounds(windows)[:-1], windows)
    order, tie = deep_shallow(buf, starts, group[hull], BYTES.size)
    times = np.bincount(tie, n_occ[hull[order]])
    out = np.zeros(len(hull), bool)
    out[order] = times[tie] > 1
    return out


SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _plain(c, shipped: np.ndarray) -> list[pa.Array]:
    size = pa.array(np.diff(c.offs))
    zero = pa.array(np.zeros(len(c), np.int64))
    return [size, zero, zero, pa.array([None if s else hashlib.sha256(c.text(i)).hexdigest() for i, s in enumerate(shipped)], pa.string())]


def _marked(c, spans: list[np.ndarray]) -> list[pa.Array]:
    removed, n_spans, shas = [], [], []
    for i, s in enumerate(spans):
        text = c.buf[c.offs[i] : c.offs[i + 1]]
        gone = covered(len(text), s)
        removed.append(int(gone.sum()))
        n_spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
        shas.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
    return [pa.array(np.diff(c.offs)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every byte under a 200-byte string that starts elsewhere too is removed."""
    docs = repeats.keyed(documents)
    return repeats.apply(docs, repeats.repeated(docs, BYTES, solve), BYTES, _plain, _marked, SCHEMA)
