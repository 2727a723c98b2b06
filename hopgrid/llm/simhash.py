"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made per document in one map stage; equal ones are pre-aggregated, so copies count
once from there on. Of limit + 1 blocks of bits, two fingerprints within the limit agree on one at
least, so each fingerprint is dealt once per block, with that block turned to its top bits. Each such
table is range-partitioned by Gray rank, in which neighbours differ in few bits. A task builds one
index over thousands of neighbouring fingerprints: every FAN of them form a node that holds the bits
they share (a masked pattern), and nodes form nodes in turn. A search adds up differences on the bits
that each level adds and drops a whole group once the sum passes the limit.

All fingerprints that agree on a block must meet in a task. Where these are more than BUCKET, they
are dealt again by blocks of their other bits, in the same way, until few enough agree on all bits so
fixed. Tasks emit star links, not pairs; components come from star contraction over the links, with
the smallest document id per component.

The contract's form is one fingerprint of 3-word shingles. A caller can ask for several independent ones
of other shingles: documents then link if any of their fingerprints do. Several narrow searches find more
of the near copies than one wide search does, and compare fewer fingerprints. They go through one index:
tables are numbered through all fingerprints of a document, so that the number of Spark's queries, whose
plans the driver holds, doesn't grow with them.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; ids may
repeat (each row is answered); a null id is never a component's id unless all of its ids are null;
extra columns, whatever their names, are ignored by `components` and kept by `keep_one`, which of
rows equal in id and text keeps the one whose other columns come first as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hopgrid.llm.text import LOWER, bounds, chunks, mix, numbered
from hopgrid.operators.components import min_labels
from hopgrid.session import cut

SHINGLE = 3
SEED = 42
LIMIT = 2
FAN = 8
BUCKET = 4096
#: Fingerprints that one index is built over, up to the end of a bucket.
SPAN = 20_000
#: Tables of one level of dealing at most: with the limit of 2, few thousand fingerprints at most agree on all
#: bits that are fixed by then. Wider limits fix fewer (31 bits at 4, 24 at 6), and what agrees on these meets in a task.
TABLES = 400
U = np.uint64


def fingerprints(c, words: int = SHINGLE, prints: int = 1) -> list[np.ndarray]:
    """64-bit fingerprints of a chunk's texts; those after the first are of the shingles' hashes, mixed anew."""
    low = LOWER[c.buf].tobytes()
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(c), np.int64)
    for i in range(len(c)):
        w = low[c.offs[i] : c.offs[i + 1]].split()
        if not w:
            continue
        text = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        k = min(words, len(w))
        starts = np.concatenate(([0], ends[: len(w) - k] + 1)).tolist()
        hashes += [digest(text[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())]
        counts[i] = len(starts)
    some, every = np.flatnonzero(counts), np.array(hashes, "<u8")
    found = []
    for k in range(prints):
        out = np.zeros(len(c), U)
        if len(some):
            own = mix(every + U(k)) if k else every
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, bounds(counts[some])[:-1], axis=0, dtype=np.int32)
            out[some] = np.packbits(2 * sums > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
        found.append(out)
    return found


def with_fingerprint(documents: DataFrame, words: int = SHINGLE, prints: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp, fp1, ...) per document: its fingerprints as signed longs."""
    names = ["fp", *[f"fp{k}" for k in range(1, prints)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            parts = [fingerprints(c, words, prints) for c in chunks(rb.column("text"))]
            fps = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, U)] * prints
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("text_hash"), *[pa.array(f.view(np.int64)) for f in fps]], names=["doc_id", "text_hash", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, " + ", ".join(f"{n} long" for n in names)
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a value in the Gray code: the running exclusive-or of its bits from the top."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class GrayIndex:
    """The hierarchy over fingerprints sorted by (tree, Gray rank). levels[0] are the fingerprints."""

    def __init__(self, tree: np.ndarray, fps: np.ndarray, limit: int = LIMIT):
        order = np.lexsort((gray_rank(fps), tree))
        self.fps, tree, self.limit = fps[order], tree[order], limit
        self.tree = tree
        self.levels = [(self.fps, np.full(len(fps), ~U(0)), np.arange(len(fps) + 1))]
        roots = int((np.diff(tree) != 0).sum()) + 1
        while len(tree) > roots:
            pattern, mask, _ = self.levels[-1]
            first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
            within = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
            heads = np.flatnonzero(within % FAN == 0)
            all_, any_ = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~(all_ ^ any_)
            self.levels.append((all_, shared, np.append(heads, len(tree))))
            tree = tree[heads]
        # The root above each fingerprint.
        root = np.arange(len(tree))
        for _, _, heads in self.levels[:0:-1]:
            root = np.repeat(root, np.diff(heads))
        self.root = root

    def links(self, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs a < b within the limit, of the same tree."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *self.met(most)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def met(self, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of `links` bit by bit: `most` queries go down at a time, so that not all pairs are held.

        By default 1024 at the contract's limit, where trees are pruned to some hundreds of nodes; at
        wider ones so many that they could visit a million nodes if nothing were pruned.
        """
        if most is None:
            most = 1024 if self.limit <= LIMIT else max(1, (1 << 20) // int(np.bincount(self.root).max(initial=1)))
        for q in range(0, len(self.fps), most):
            who = np.arange(q, min(len(self.fps), q + most))
            node = self.root[who]
            pattern, mask, _ = self.levels[-1]
            diff = np.bitwise_count((self.fps[who] ^ pattern[node]) & mask[node]).astype(np.int64)
            above = mask
            for k in range(len(self.levels) - 1, 0, -1):
                near = diff <= self.limit
                who, node, diff = who[near], node[near], diff[near]
                heads = self.levels[k][2]
                n = heads[node + 1] - heads[node]
                child = np.repeat(heads[node] - bounds(n)[:-1], n) + np.arange(n.sum())
                seen = np.repeat(above[node], n)
                who, diff = np.repeat(who, n), np.repeat(diff, n)
                pattern, above, _ = self.levels[k - 1]
                diff = diff + np.bitwise_count((self.fps[who] ^ pattern[child]) & above[child] & ~seen)
                node = child
            ok = (diff <= self.limit) & (who < node)
            yield who[ok], node[ok]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs from each linked fingerprint to the first of its group: the same groups with fewer rows."""
        label = np.arange(len(self.fps))
        for a, b in self.met():
            while True:
                a, b = label[a], label[b]  # the first of each group so far
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        own = np.flatnonzero(label != np.arange(len(label)))
        return own, label[own]


def blocks(mask: int, limit: int) -> list[int]:
    """The bits outside a mask in limit + 1 blocks of almost equal size, as masks."""
    free = [b for b in range(64) if not mask >> b & 1]
    edge = [len(free) * k // (limit + 1) for k in range(limit + 2)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(edge, edge[1:])]


def turned(fps: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The fingerprints turned left by so many bits (0 to 63) each."""
    by = by.astype(U)
    return (fps << by) | (fps >> ((U(64) - by) & U(63)) & np.where(by == 0, U(0), ~U(0)))


def _search(limit: int, per: int, turns: list[int] | None):
    """Star links (p, src, dst) of rows (m, key, fp) sorted by (m, key); print p has the tables m from p * per on. With `turns` for each table of a print, one tree spans all keys of a table; else each key has its own."""

    def out(rows: np.ndarray) -> pa.RecordBatch:
        m, fps = rows[:, 0], rows[:, 2].copy().view(U)
        if turns:
            by = np.array(turns)
            index = GrayIndex(m, turned(fps, by[m % per]), limit)
            a, b = index.stars()
            m = index.tree[a]
            ends = [turned(index.fps[x], ((64 - by) % 64)[m % per]) for x in (a, b)]
        else:
            keys, tree = np.unique(rows[:, :2], axis=0, return_inverse=True)
            index = GrayIndex(tree.ravel(), fps, limit)
            a, b = index.stars()
            m = keys[index.tree[a], 0]
            ends = [index.fps[x] for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(m // per), *[pa.array(x.view(np.int64)) for x in ends]], names=["p", "src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rb in batches:
            rows = np.stack([x.to_numpy() for x in rb.columns], 1)
            if held and len(rows) and sum(map(len, held)) > SPAN:
                other = np.flatnonzero((rows[:, :2] != held[-1][-1, :2]).any(1))  # the open bucket goes on up to here
                k = int(other[0]) if len(other) else len(rows)
                held.append(rows[:k])
                if k < len(rows):
                    yield out(np.concatenate(held))
                    held = []
                rows = rows[k:]
            if len(rows):
                held.append(rows)
        if held:
            yield out(np.concatenate(held))

    return run


def _gray(x: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(src, dst) over distinct fingerprints fp: enough links to connect all pairs at `limit` or fewer differing bits."""
    return links_by_print(fps.select(F.lit(0).cast("long").alias("p"), "fp"), limit).select("src", "dst")


def links_by_print(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(p, src, dst) over distinct (p, fp), p from 0: for each p, enough links to connect all its pairs at `limit` or fewer differing bits."""
    masks, level = blocks(0, limit), 0
    lows = [(m & -m).bit_length() - 1 for m in masks]
    rank = lambda m, low: _gray(F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(m))), low))
    tables = [F.struct((F.col("p") * len(masks) + k).alias("m"), rank(m, low).alias("key"), "fp") for k, (m, low) in enumerate(zip(masks, lows))]
    dealt, found = fps.select(F.inline(F.array(*tables))), None
    while True:
        sizes = cut(dealt.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        last = all(64 - m.bit_count() <= 13 for m in masks) or len(masks) * (limit + 1) > TABLES
        large = sizes.filter(F.col("n") > BUCKET).select("m", "key")
        small = sizes if last else sizes.filter(F.col("n") <= BUCKET)
        met = dealt.join(small.select("m", "key"), ["m", "key"]).select("m", "key", "fp").repartitionByRange("m", "key").sortWithinPartitions("m", "key")
        # Beyond the contract's limit a tree over many keys would be pruned too little: each key has its own.
        turns = [(64 - m.bit_length()) for m in masks] if level == 0 and limit <= LIMIT else None
        own = met.mapInArrow(_search(limit, len(masks), turns), "p long, src long, dst long")
        found = own if found is None else found.union(own)
        if last or large.isEmpty():
            return found
        masks = [m | b for m in masks for b in blocks(m, limit)]
        child = F.explode(F.sequence(F.col("m") * (limit + 1), F.col("m") * (limit + 1) + limit))
        again = dealt.join(large, ["m", "key"], "left_semi").select("fp", child.alias("m"))
        bits = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), (F.col("m") % len(masks) + 1).cast("int"))
        dealt, level = cut(again.select("m", F.col("fp").bitwiseAND(bits).alias("key"), "fp")), level + 1


def _linked(prints: DataFrame, limit: int) -> DataFrame:
    """(src, dst) over first fingerprints: enough links to connect all rows of which some fingerprint is within the limit.

    The least first fingerprint of each value of another one stands for the rows that share it.
    """
    names = ["fp", *prints.columns[3:]]
    values = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.col(c).alias("value"), F.col("fp").alias("own")) for p, c in enumerate(names)])
    pairs = cut(prints.select(F.inline(values)).distinct())
    least = cut(pairs.groupBy("p", "value").agg(F.min("own").alias("least")))
    shared = pairs.join(least, ["p", "value"]).filter("own <> least").select(F.col("own").alias("src"), F.col("least").alias("dst"))
    own = cut(links_by_print(least.select("p", F.col("value").alias("fp")), limit).distinct())
    for end in ("src", "dst"):
        own = own.join(least.withColumnRenamed("value", end), ["p", end]).drop(end).withColumnRenamed("least", f"{end}_")
    return own.drop("p").toDF("src", "dst").union(shared)


def groups(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(fp, component_id, first): component of each distinct first fingerprint; first is its first (doc_id, text_hash)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = cut(prints.groupBy("fp").agg(first.alias("first")))
    found = _linked(prints, limit) if prints.columns[3:] else links(distinct.select("fp"), limit)
    labels = min_labels(cut(found.distinct())).withColumnRenamed("v", "fp")
    labelled = cut(distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    best = labelled.groupBy("label").agg(F.min("first").alias("first"))
    return labelled.select("fp", "label").join(best, "label").select("fp", F.col("first.doc_id").alias("component_id"), "first")


def components(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = cut(with_fingerprint(documents))
    joined = prints.join(groups(prints, limit).select("fp", "component_id"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, limit: int = LIMIT, words: int = SHINGLE, prints: int = 1) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Documents are linked if any of their `prints` fingerprints of `words`-word shingles are within the limit.

    The choice is made on (doc_id, hash of the text); of rows equal in both one stays. Texts cross one exchange.
    """
    own, names = numbered(documents), documents.columns
    id_, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    printed = cut(with_fingerprint(documents, words, prints))
    chosen = cut(groups(printed, limit).select("first").distinct().select("first.doc_id", "first.text_hash"))
    keyed = own.withColumn("own_hash", F.xxhash64(text))
    hit = keyed.join(chosen, F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left_semi")
    rest = F.to_json(F.struct(F.lit(0), *[c for c in own.columns if c not in (id_, text)]))
    one = hit.withColumn("copy", F.row_number().over(Window.partitionBy(id_, "own_hash").orderBy(rest)))
    return one.filter("copy = 1").select(*own.columns).toDF(*names)
