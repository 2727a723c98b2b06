"""Benchmark decontamination by winnowing.

Every 13-word window holds 7 k-grams of 7 words; the least hash of each window is kept on both
sides. A shared window keeps the same k-gram on either side, so joining fingerprints misses no
shared window. Each hit is then extended: the windows around it are looked up among the benchmark's
by hash, and their words compared, so that no two different windows are taken for one another.
Items shorter than a window are one window, and their k-gram is the whole item.

The benchmark is a stated query set. Its items are cut into pieces of at most a tenth of BLOCK_WORDS
words, which overlap by a window less a word, and dealt into blocks of about BLOCK_WORDS words (by a
count made first), each broadcast in turn; documents pass by all blocks in one map stage and are
never shuffled.

Defined cases: null or empty texts have no words (n_hit 0, not contaminated); items without words
match nothing; null item ids are shown as "null"; equal items with different ids all count;
repeated documents are answered row by row; extra columns, whatever their names, are kept by
`keep_clean` and `find` and ignored by `contamination`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.llm.text import ALNUM, LOWER, Roller, bounds, chunks, grams, numbered, single_spaced, span_hash, window_argmin, words
from hopgrid.session import cut

WINDOW = 13
K = 7
#: Words of benchmark text in one broadcast block: about 60 bytes a word with its text, so some 60 MB.
BLOCK_WORDS = 1_000_000
#: Blocks that one map stage passes; more go through a checkpoint in between.
CHAIN = 3
WORD_SEED = 11
_GRAM, _WIN = Roller(12), Roller(13)


class Words:
    """The lower-cased words of a chunk, single-spaced: hashes, counts a text, and byte spans in `buf`."""

    def __init__(self, chunk):
        buf = LOWER[chunk.buf]
        starts, ends, self.counts = words(buf, chunk.offs, ALNUM)
        self.hashes = span_hash(buf, starts, ends, WORD_SEED)
        self.buf, self.starts, self.ends = single_spaced(buf, starts, ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return grams(_WIN, self.hashes, self.counts, n)


def winnow(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word positions) of the k-grams that some whole 13-word window keeps."""
    h, at = grams(_GRAM, values, counts, K)
    w = WINDOW - K + 1
    best = window_argmin(h, w)
    whole = at[w - 1 :] - at[: len(best)] == w - 1 if len(best) else np.zeros(0, bool)  # within one text
    kept = np.unique(best[whole])
    return h[kept], at[kept]


class Index:
    """Fingerprints and windows of a block of items. Equal windows form a class with its words and its owners."""

    def __init__(self, items: pa.Table):
        texts = items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string())
        prints, wins, owner, lengths, begin, end, raw, size = [], [], [], [], [], [], [], 0
        for c in chunks(texts):
            w = Words(c)
            prints.append(winnow(w.hashes, w.counts)[0])
            doc = np.repeat(np.arange(len(c)), w.counts) + c.first
            short = (w.counts > 0) & (w.counts < WINDOW)
            sized = [(WINDOW, np.ones(len(c), bool))] + [(int(n), w.counts == n) for n in np.unique(w.counts[short])]
            for n, which in sized:
                h, at = w.grams(n)
                own = which[doc[at] - c.first] if len(at) else np.zeros(0, bool)
                h, at = h[own], at[own]
                wins.append(h)
                owner.append(doc[at])
                lengths.append(np.full(len(at), n))
                begin.append(w.starts[at] + size)
                end.append(w.ends[at + n - 1] + size)
            raw.append(w.buf.tobytes())
            size += len(w.buf)
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        self.prints, self.raw = np.unique(cat(prints, np.uint64)), b"".join(raw)
        wins, owner, lengths, begin, end = cat(wins, np.uint64), cat(owner, np.int64), cat(lengths, np.int64), cat(begin, np.int64), cat(end, np.int64)
        self.shorter = [int(n) for n in np.unique(lengths) if n < WINDOW]
        order = np.argsort(wins, kind="stable")
        new = np.ones(len(order), bool)
        same = np.flatnonzero(wins[order][1:] == wins[order][:-1]) + 1
        new[same] = False
        text = lambda k: self.raw[begin[k] : end[k]]
        if any(text(order[k]) != text(order[k - 1]) for k in same.tolist()):  # different words of one hash: ordered by them
            order = np.array(sorted(range(len(wins)), key=lambda k: (wins[k], text(k))), np.int64)
            new[same] = [text(order[k]) != text(order[k - 1]) for k in same.tolist()]
        first = np.flatnonzero(new)
        self.wins, self.begin, self.end = wins[order[first]], begin[order[first]], end[order[first]]
        self.owner, self.edge = owner[order], np.append(first, len(order))
        ids = items.column("item_id").to_pylist()
        self.ids = ["null" if i is None else str(i) for i in ids]

    def classes(self, w: Words, h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The class of each window of n words, or -1: hashes are looked up, then words compared."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.wins):
            return out
        near = np.searchsorted(self.wins, h)
        for k in np.flatnonzero(self.wins[np.minimum(near, len(self.wins) - 1)] == h).tolist():
            own, c = w.buf[w.starts[at[k]] : w.ends[at[k] + n - 1]].tobytes(), int(near[k])
            while c < len(self.wins) and self.wins[c] == h[k]:
                if self.raw[self.begin[c] : self.end[c]] == own:
                    out[k] = c
                    break
                c += 1
        return out

    def items(self, classes: np.ndarray) -> set[str]:
        return {self.ids[k] for c in classes.tolist() for k in np.unique(self.owner[self.edge[c] : self.edge[c + 1]])}

    def hits(self, w: Words) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(classes, first words, length) of the windows that occur here."""
        out = []
        if len(self.prints):
            h, at = winnow(w.hashes, w.counts)
            near = np.minimum(np.searchsorted(self.prints, h), len(self.prints) - 1)
            at = at[self.prints[near] == h]
            if len(at):
                starts = np.unique((at[:, None] - np.arange(WINDOW - K + 1)).ravel())  # windows that hold the k-gram
                h, every = w.grams(WINDOW)
                pick = np.isin(every, starts, assume_unique=True)
                out.append((h[pick], every[pick], WINDOW))
        out += [(*w.grams(n), n) for n in self.shorter]
        found = [(self.classes(w, h, at, n), at, n) for h, at, n in out]
        return [(c[c >= 0], at[c >= 0], n) for c, at, n in found if (c >= 0).any()]


#: Columns that the passes add behind the caller's own: words, [first, end) spans of word positions, items.
FOUND = {"n_words": "long", "spans": "array<int>", "items": "array<string>"}


def _pass(docs: DataFrame, text: int, shared, finish=None, schema=None) -> DataFrame:
    """Add one block's findings to the last three columns. The last pass can end in finish(batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for rb in batches:
            n_words, spans, items = [], rb.column(rb.num_columns - 2).to_pylist(), rb.column(rb.num_columns - 1).to_pylist()
            for c in chunks(rb.column(text)):
                w = Words(c)
                edge = bounds(w.counts)
                n_words += w.counts.tolist()
                for cls, at, n in index.hits(w):
                    doc = np.searchsorted(edge, at, "right") - 1
                    for d in np.unique(doc):
                        own = doc == d
                        first = at[own] - edge[d]
                        row = c.first + int(d)
                        gap = np.flatnonzero(np.diff(first) > n)
                        begin, end = first[np.concatenate(([0], gap + 1))], first[np.concatenate((gap, [len(first) - 1]))] + n
                        spans[row] = (spans[row] or []) + np.stack((begin, end), 1).ravel().tolist()
                        items[row] = sorted(set(items[row] or []) | index.items(np.unique(cls[own])))
            added = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*rb.columns[: -len(FOUND)], *added], names=rb.schema.names)
            yield finish(out) if finish else out

    return docs.mapInArrow(run, schema or docs.schema)


def pieces(benchmark: DataFrame, most: int) -> DataFrame:
    """(item_id, piece, text): the different items, long ones in pieces of `most` window starts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for c in chunks(rb.column("text")):
                w = Words(c)
                edge = bounds(w.counts)
                for i in range(len(c)):
                    a, b = int(edge[i]), int(edge[i + 1])
                    at = np.arange(a, max(a + 1, b - WINDOW + 1), most) if b > a else np.zeros(0, np.int64)
                    texts = [w.buf[w.starts[s] : w.ends[min(b, s + most + WINDOW - 1) - 1]].tobytes().decode("utf-8", "replace") for s in at.tolist()]
                    ids = rb.column("item_id").take(pa.array(np.full(len(at), c.first + i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(at))), pa.array(texts, pa.string())], names=["item_id", "piece", "text"])

    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, piece long, text string")


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark dealt into parts of about `most` words, by a hash of the piece."""
    items = cut(pieces(benchmark, max(WINDOW, most // 10)))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 2 + 1  # two bytes a word at least
    n = -(-size // most)
    if n == 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "piece", "text"), F.lit(n))
    return [items.filter(part == i) for i in range(n)]


def find(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_WORDS, finish=None, schema=None) -> DataFrame:
    """The documents' columns, numbered, with FOUND's behind them: the word spans that benchmark windows cover, and whose they are.

    finish turns a batch of that into one of `schema`, inside the last pass.
    """
    text = documents.columns.index("text")
    out = numbered(documents).withColumns({k: F.lit(0).cast(t) if t == "long" else F.lit(None).cast(t) for k, t in FOUND.items()})
    parts = blocks(benchmark, most)
    for i, b in enumerate(parts):
        if i and i % CHAIN == 0:
            out = cut(out)
        shared = documents.sparkSession.sparkContext.broadcast(Index(b.toArrow()))
        out = _pass(out, text, shared, finish, schema) if i + 1 == len(parts) else _pass(out, text, shared)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """The contract's columns for every document. Covered words of overlapping spans count once."""

    def finish(rb: pa.RecordBatch) -> pa.RecordBatch:
        hit = [covered(s) for s in rb.column("spans").to_pylist()]
        items = [sorted(x or []) for x in rb.column("items").to_pylist()]
        n = rb.column("n_words").to_pylist()
        cols = {
            "doc_id": rb.column("c0"),
            "n_words": rb.column("n_words"),
            "n_hit": pa.array(hit, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            "contaminated": pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n)], pa.bool_()),
        }
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return find(documents.select("doc_id", "text"), benchmark, most, finish, schema)


def covered(spans: list[int] | None) -> int:
    total, reach = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2])) if spans else ():
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""

    def finish(rb: pa.RecordBatch) -> pa.RecordBatch:
        n_words, spans, _ = rb.columns[-len(FOUND) :]
        hit = np.array([covered(s) for s in spans.to_pylist()], np.int64)
        clean = (hit == 0) | (20 * hit < n_words.to_numpy())
        return rb.select(list(range(rb.num_columns - len(FOUND)))).filter(pa.array(clean))

    return find(documents, benchmark, finish=finish, schema=numbered(documents).schema).toDF(*documents.columns)
