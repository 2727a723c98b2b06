"""Exact search for windows of text that occur more than once in a corpus, without a suffix per position.

A text is a sequence of units (bytes or words); a window is `size` consecutive units. Winnowing gives
every window one anchor: the least hashed gram inside it. Consecutive windows with the same anchor are
a run, and the text under a run is its hull. Equal windows have equal anchors, so:

1. Per anchor hash Spark counts runs, and tells whether their hulls are all the same. An anchor seen
   once holds no repeated window; where all hulls are the same, all their windows are repeated.
2. Where hulls differ, equal hulls are pre-aggregated to classes with a count. A class with two or
   more occurrences is repeated as a whole. The others are compared with the hulls of the same anchor:
   hulls are fetched from their texts, dealt by anchor, and each anchor's set is solved exactly by
   the operator's own method (`solve`), in bounded batches.
3. A set of over GROUP hulls is split first: each hull is cut into runs by a longer gram (the next of
   `Kind.grams`), so that equal windows fall into the same smaller set; equal pieces are pre-aggregated
   again, and the pieces' sets are solved in the same way. The last gram is the window itself, so a
   set ends as one class at the latest.

Hulls count as equal by a 128-bit BLAKE2b of their units (words single-spaced); sets are solved on the
units themselves. Anchors come from plain hashes, which only decide what is compared with what.

Only anchors, counts and such hulls cross exchanges; a hot anchor is pre-aggregated before any. Texts
move only where needed: a filter over the wanted document keys, of 8 bits a key and 128 MB at most,
keeps the others in place (beyond that more texts move than needed, with the same result). A document is known by (doc_id,
first 128 bits of its text's SHA-256), as texts with equal faster hashes are easily made; rows that are equal in both have
equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.llm.text import NOT_SPACE, Roller, bounds, chunks, mix, single_spaced, span_hash, window_argmin, words
from hopgrid.session import cut, store

U = np.uint64
FILTER_BITS = (1 << 20, 1 << 30)
GROUP = 4096
SLICE = 1 << 20
_BYTE, _GRAM = Roller(31), Roller(33)
WORD_SEED = 32


@dataclass(frozen=True)
class Kind:
    """What a unit is, units a window, units a gram by level of splitting, windows that a task solves at a time."""

    words: bool
    size: int
    grams: tuple[int, ...]
    batch: int


class Units:
    """The units of a chunk's texts: values to hash, how many a text has, and their bytes."""

    def __init__(self, c, kind: Kind):
        if kind.words:
            starts, ends, self.counts = words(c.buf, c.offs, NOT_SPACE)
            self.values = span_hash(c.buf, starts, ends, WORD_SEED)
            self.buf, self.starts, self.ends = single_spaced(c.buf, starts, ends)
        else:
            self.values, self.counts, self.buf, self.starts = _BYTE.values[c.buf], np.diff(c.offs), c.buf, None

    def bodies(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The bytes of units [first, last) of each span."""
        if self.starts is not None and len(first):
            first, last = self.starts[first], self.ends[last - 1]
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]


def digests(bodies: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two signed integers."""
    raw = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in bodies])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def runs(v: np.ndarray, counts: np.ndarray, kind: Kind, level: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, first unit) of all runs; windows never cross texts."""
    size, k = kind.size, kind.grams[level]
    w = size - k + 1
    edge = bounds(counts)
    out = []
    text_of = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, max(0, len(v) - size + 1), SLICE if len(counts) == 1 else max(1, len(v))):
        b = min(len(v), a + SLICE + size - 1) if len(counts) == 1 else len(v)
        own = v[a:b]
        prefix = _GRAM.prefix(own)
        at = np.arange(len(own) - k + 1)
        h = _GRAM.spans(prefix, at, at + k)
        best = window_argmin(h, w)
        start = np.arange(len(best))
        text = text_of[a : a + len(best)]
        whole = text == text_of[a + size - 1 : a + size - 1 + len(best)]
        start, best, text = start[whole], best[whole], text[whole]
        if not len(start):
            continue
        new = np.concatenate(([True], (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])))
        head = np.flatnonzero(new)
        lo, anchor, n = start[head], best[head], np.diff(np.append(head, len(start)))
        out.append((text[head], a + lo - edge[text[head]], n, h[anchor], a + lo))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U), z
    return tuple(np.concatenate(x) for x in zip(*out))


def keyed(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("th", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    """(h, c, e, doc_id, th, lo, n) of every run of docs(doc_id, text, th); c and e are its hull's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for chunk in chunks(rb.column("text")):
                u = Units(chunk, kind)
                text, lo, n, h, first = runs(u.values, u.counts, kind)
                hull = digests(u.bodies(first, first + n - 1 + kind.size))
                row = pa.array(text + chunk.first)
                cols = [pa.array(h.view(np.int64)), pa.array(hull[:, 0]), pa.array(hull[:, 1]), rb.column("doc_id").take(row), rb.column("th").take(row), pa.array(lo), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "c", "e", "doc_id", "th", "lo", "n"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"h long, c long, e long, doc_id {_id(docs)}, th binary, lo long, n int")


def _id(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap over keys(th), about 8 bits a key: no key of the set is missed; others mostly are."""
    keys = keys.select("th").distinct()
    least, most = FILTER_BITS
    bits = least
    while bits < min(most, 8 * keys.count()):
        bits *= 2
    spot = F.pmod(F.xxhash64("th"), F.lit(bits))
    cells = keys.select(F.shiftright(spot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int")).alias("bit"))
    table = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["cell"].to_numpy()] = table["bits"].to_numpy()
    return out


def _wanted(cells: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (cells[spot >> 6].view(U) >> (spot & 63).astype(U)) & U(1) > 0


def shipped(docs: DataFrame, wanted: DataFrame, rest: Callable | None = None, rest_schema: str = "") -> DataFrame:
    """docs(doc_id, th, packed) with the compressed text of documents that may be in wanted(th).

    The others are left out, or, with `rest` (chunk → columns by rest_schema), kept without a text and
    with those columns, which are null for shipped ones.
    """
    cells = key_filter(wanted)
    bits = 64 * len(cells)
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    names = [x.split()[0] for x in rest_schema.split(", ")] if rest_schema else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for rb in batches:
            ship = _wanted(shared.value, rb.column("spot").to_numpy())
            for c in chunks(rb.column("text")):
                own = ship[c.first : c.first + len(c)]
                packed = [pack(c.text(i)) if s else None for i, s in enumerate(own)]
                cols = [rb.column("doc_id").slice(c.first, len(c)), rb.column("th").slice(c.first, len(c)), pa.array(packed, pa.binary())]
                if rest:
                    cols += rest(c, own)
                out = pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "packed", *names])
                yield out if rest else out.filter(pa.array(own))

    spot = F.pmod(F.xxhash64("th"), F.lit(bits))
    schema = f"doc_id {_id(docs)}, th binary, packed binary" + (f", {rest_schema}" if rest_schema else "")
    return docs.select("doc_id", "th", spot.alias("spot"), "text").mapInArrow(run, schema)


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of shipped documents."""
    read = zstandard.ZstdDecompressor().decompress
    return pa.array([read(x) if x is not None else b"" for x in column.to_pylist()], pa.binary())


def hulls(docs: DataFrame, classes: DataFrame, kind: Kind) -> DataFrame:
    """(h, c, e, n_occ, n, hull) of classes(h, c, e, n_occ, n, doc_id, th, lo): the bytes of the units under each class's first run."""
    # One row per document: two rows that are equal in key have equal texts.
    texts = shipped(docs, classes.select("th"))
    wants = classes.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "c", "e", "n_occ", "n", "lo")).alias("wants"))
    joined = wants.join(texts.withColumnRenamed("doc_id", "d2").withColumnRenamed("th", "t2"), wants["doc_id"].eqNullSafe(F.col("d2")) & (wants["th"] == F.col("t2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            lists = rb.column("wants")
            for chunk in chunks(unpacked(rb.column("packed"))):
                u = Units(chunk, kind)
                own = lists.slice(chunk.first, len(chunk))
                flat, text = own.flatten(), np.repeat(np.arange(len(chunk)), np.array([len(x) for x in own]))
                h, c, e, n_occ, n, lo = (flat.field(k) for k in range(6))
                first = bounds(u.counts)[text] + lo.to_numpy()
                body = pa.array(u.bodies(first, first + n.to_numpy() - 1 + kind.size), pa.binary())
                yield pa.RecordBatch.from_arrays([h, c, e, n_occ, n, body], names=["h", "c", "e", "n_occ", "n", "hull"])

    return joined.select("wants", "packed").mapInArrow(run, HULLS)


HULLS = "h long, c long, e long, n_occ long, n int, hull binary"
RANGES = "h long, c long, e long, ranges array<int>"

#: solve(groups, n_occ, windows, hulls) gives for every window of every hull whether it is repeated;
#: groups number the hulls' anchors, hulls are the bytes of their units, windows how many each has.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], np.ndarray]


def _ranges(flags: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per hull the [first, end) ranges of its repeated windows, flat."""
    edge = bounds(n)
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    hull = np.repeat(np.arange(len(n)), n)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lists: list[list[int]] = [[] for _ in n]
    for s, e in zip(start.tolist(), end.tolist()):
        while s < e:  # a range may go over hulls that lie side by side
            k = int(hull[s])
            to = min(e, int(edge[k + 1]))
            lists[k] += [s - int(edge[k]), to - int(edge[k])]
            s = to
    return pa.array(lists, pa.list_(pa.int32()))


def solved(fetched: DataFrame, kind: Kind, solve: Solve) -> DataFrame:
    """(h, c, e, ranges) of hulls seen once that have repeated windows; fetched has all hulls of an anchor."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        h, n_occ, n = rows["h"].to_numpy(), rows["n_occ"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        _, group = np.unique(h, return_inverse=True)
        ranges = _ranges(solve(group, n_occ, n, rows["hull"].to_pylist()), n)
        batch = pa.RecordBatch.from_arrays([*(rows[k].combine_chunks() for k in "hce"), ranges], names=["h", "c", "e", "ranges"])
        return batch.filter(pa.array((n_occ == 1) & (np.array([len(x) for x in ranges]) > 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for rb in batches:
            while rb.num_rows:
                h = rb.column("h").to_numpy()
                if windows >= kind.batch:
                    last = held[-1].column("h")[-1].as_py()
                    k = int(np.searchsorted(h, last, "right"))
                    held.append(rb.slice(0, k))
                    rb = rb.slice(k)
                    if not rb.num_rows:
                        break
                    yield out(pa.Table.from_batches(held))
                    held, windows = [], 0
                    h = h[k:]
                load = np.cumsum(rb.column("n").to_numpy())
                k = int(min(len(load), np.searchsorted(load, kind.batch - windows) + 1))
                held.append(rb.slice(0, k))
                windows += int(load[k - 1])
                rb = rb.slice(k)
        if held:
            yield out(pa.Table.from_batches(held))

    dealt = fetched.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, RANGES)


def split(fetched: DataFrame, kind: Kind, level: int) -> DataFrame:
    """The hulls cut into runs by the gram of a level: (h, c, e, n_occ) of the hull, the run's first window in it, and its own h, c, e, n, hull."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for chunk in chunks(rb.column("hull")):
                u = Units(chunk, kind)
                own, lo, n, h, first = runs(u.values, u.counts, kind, level)
                row = pa.array(own + chunk.first)
                body = u.bodies(first, first + n - 1 + kind.size)
                mark = digests(body)
                up = [rb.column(k).take(row) for k in ("h", "c", "e", "n_occ")]
                below = mix(up[0].to_numpy().view(U) ^ mix(h)).view(np.int64)
                cols = [*up, pa.array(lo.astype(np.int32)), pa.array(below), pa.array(mark[:, 0]), pa.array(mark[:, 1]), pa.array(n.astype(np.int32)), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["h0", "c0", "e0", "n_occ", "at", "h", "c", "e", "n", "hull"])

    return fetched.mapInArrow(run, "h0 long, c0 long, e0 long, n_occ long, at int, h long, c long, e long, n int, hull binary")


def settled(fetched: DataFrame, kind: Kind, solve: Solve, level: int = 0) -> DataFrame:
    """`solved` for sets of any size: those of over GROUP hulls are split by the next level's gram."""
    if level + 1 == len(kind.grams):  # a set is one window, so one class
        return solved(fetched, kind, solve)
    large = cut(fetched.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > GROUP).select("h"))
    if large.isEmpty():
        return solved(fetched, kind, solve)
    pieces = store(split(fetched.join(large, "h", "left_semi").select(*fetched.columns), kind, level + 1))
    below = store(pieces.groupBy("h", "c", "e").agg(F.sum("n_occ").alias("n_occ"), F.first("n").alias("n"), F.first("hull").alias("hull")))
    whole = below.filter("n_occ > 1").select("h", "c", "e", F.array(F.lit(0), F.col("n")).alias("ranges"))
    found = settled(below, kind, solve, level + 1).union(whole)
    back = pieces.filter("n_occ = 1").select("h0", "c0", "e0", "at", "h", "c", "e").join(found, ["h", "c", "e"])
    own = back.groupBy(F.col("h0").alias("h"), F.col("c0").alias("c"), F.col("e0").alias("e")).agg(F.flatten(F.collect_list(F.transform("ranges", lambda x: x + F.col("at")))).alias("ranges"))
    return solved(fetched.join(large, "h", "left_anti").select(*fetched.columns), kind, solve).union(own)


def repeated(docs: DataFrame, kind: Kind, solve: Solve) -> DataFrame:
    """(doc_id, th, spans): [first, end) unit spans, flat, that repeated windows cover, for documents that have any."""
    runs_ = store(anchors(docs, kind))
    uniform = (F.min("c") == F.max("c")) & (F.min("e") == F.max("e"))
    per_anchor = runs_.groupBy("h").agg(F.count(F.lit(1)).alias("k"), (~uniform).alias("mixed")).filter("k > 1").select("h", "mixed")
    per_anchor = store(per_anchor)  # a join of two plain exchanges, whose hot partitions Spark can split
    hit = store(runs_.join(per_anchor, "h"))
    classes = hit.filter("mixed").groupBy("h", "c", "e").agg(F.count(F.lit(1)).alias("n_occ"), F.first("n").alias("n"), F.min(F.struct("doc_id", "th", "lo")).alias("r"))
    classes = store(classes.select("h", "c", "e", "n_occ", "n", "r.doc_id", "r.th", "r.lo"))
    ranges = settled(store(hulls(docs, classes, kind)), kind, solve)
    span = lambda a, b: F.struct((F.col("lo") + a).alias("a"), (F.col("lo") + b - 1 + kind.size).alias("b"))
    zero = F.lit(0).cast("long")
    plain = hit.filter("not mixed").select("doc_id", "th", span(zero, F.col("n")).alias("s"))
    more = hit.filter("mixed").join(classes.filter("n_occ > 1").select("h", "c", "e"), ["h", "c", "e"]).select("doc_id", "th", span(zero, F.col("n")).alias("s"))
    pairs = F.expr("transform(sequence(0, cast(size(ranges) div 2 as int) - 1), k -> struct(ranges[2 * k] as x, ranges[2 * k + 1] as y))")
    fine = ranges.join(classes.filter("n_occ = 1"), ["h", "c", "e"]).select("doc_id", "th", "lo", F.explode(pairs).alias("p")).select("doc_id", "th", span(F.col("p.x"), F.col("p.y")).alias("s"))
    marks = plain.union(more).union(fine).groupBy("doc_id", "th").agg(F.collect_set("s").alias("spans"))
    return store(marks)


def apply(docs: DataFrame, marks: DataFrame, kind: Kind, plain: Callable, marked: Callable, schema: str) -> DataFrame:
    """Results per document: plain(chunk, which are shipped) for those without spans, marked(chunk, spans) for the others.

    Both give columns by `schema`; spans are per text an ascending array of rows (first, end).
    """
    names = [x.split()[0] for x in schema.split(", ")]
    texts = shipped(docs, marks.select("th"), plain, schema)
    right = marks.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "spans")
    joined = texts.join(right, texts["doc_id"].eqNullSafe(F.col("__d")) & (texts["th"] == F.col("__t")), "left").select("doc_id", "packed", "spans", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ready = rb.column("packed").is_null()
            done = rb.filter(ready)
            yield done.select(["doc_id", *names])
            rb = rb.filter(pa.array(~ready.to_numpy(zero_copy_only=False)))
            lists = rb.column("spans").fill_null([]) if rb.num_rows else None
            for c in chunks(unpacked(rb.column("packed"))):
                own = lists.slice(c.first, len(c))
                flat = own.flatten()
                ends = np.cumsum([len(x) for x in own])
                pair = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], 1)
                spans = np.split(pair, ends[:-1])
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(c.first, len(c)), *marked(c, spans)], names=["doc_id", *names])

    return joined.mapInArrow(run, f"doc_id {_id(docs)}, {schema}")


def covered(length: int, spans: np.ndarray) -> np.ndarray:
    """Flags of the units under any span."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0
