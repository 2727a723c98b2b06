"""Quality rules: word statistics, and n-gram perplexity under a modified Kneser-Ney model.

The models are over bytes (order 5): a text is its words, each followed by one blank, so that grams
cross word borders, and no word is unknown. Spark counts the 5-grams of the corpus: tasks count their
own texts first, the exchange sums per (model, 5-gram). Lower orders use continuation counts, and
every order keeps its own three discounts. The result is a set of sorted arrays of hashed keys
(a 64-bit mix that is one-to-one on 5 bytes, so keys never collide) with log-probabilities and
back-off weights, found by binary search.

All texts that can be prose feed the models: those that pass the base rules, with at most FEED_SYMBOLS
symbols a word and FEED_CAPITALS of their letters capitals. A language's texts are dealt into two
folds by a hash of the text, each fold has its model, and every text is scored by the model of the
fold it isn't in. So no text and no exact copy of it feeds the model that scores it (near copies can).

The arrays are broadcast in parts of about PART_GRAMS 5-grams, dealt by the two bytes before the
predicted one: all that a 5-gram's score needs of orders 3 to 5 is in its own part, orders 1 and 2 (at
most 65,792 grams a model) are in every part. Discounts and counts are those of the whole table, so
the number of parts doesn't change a score. The driver and a task hold one part at a time.

With labels, bands come from all texts labelled good that pass the base rules. A band is what keeps KEPT of them, by quantiles of
their scores: per language and class of length (LENGTHS) if it has LEAST_GOOD such texts; a language's
other classes share a band, or all of them if the others have fewer together. A language with fewer
good labels (or all, without labels) has no such quantiles: its band lies from SPREAD_LOW median
deviations below to SPREAD_HIGH above its median, over all its texts that pass the base rules;
deviations are scaled to a length of FULL_WORDS words, as short texts scatter more. Documents below
the lower or above the upper band are rejected.

Defined cases: a null or empty text has no words (base_failed, perplexity null); a null language is a
language of its own, the empty one another; a text without a model or band passes if the base rules
let it; repeated rows count and are answered row by row; an empty table gives no rows; extra columns,
whatever their names, are kept by `keep_good` and ignored by `verdicts`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopgrid.llm.text import NOT_SPACE, Roller, bounds, byte_class, chunks, grams, mix, numbered, single_spaced, span_hash, words
from hopgrid.session import cut, store

ORDER = 5
MIN_WORDS = 50
MAX_REPEAT = 50  # percent of words in repeated 3-word windows
FEED_SYMBOLS, FEED_CAPITALS = 0.1, 0.3
PART_GRAMS = 4_000_000
CHUNK_BYTES = 1 << 20  # larger than usual: a chunk looks up each of its different grams once
MAX_BANDS = 100_000  # rows of bands (four a language) that are broadcast; more are joined by an exchange
SPREAD_LOW, SPREAD_HIGH = 7.0, 12.0
FULL_WORDS = 400
KEPT = 0.99
LENGTHS = (100, 200, 400)
LEAST_GOOD = 200  # with fewer, the outermost half percent on a side isn't one text
START = 0x0A  # a byte that no word holds
WORD_SEED, LINE_SEED = 21, 22
_SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
_CAPITAL = byte_class(lambda b: 0x41 <= b <= 0x5A)
_LETTER = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_TRI = Roller(23)
U = np.uint64


def key(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of packed grams of one order; one-to-one, as `mix` is and codes have 40 bits."""
    return mix(codes | U(order << 40))


def packed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram codes, how many each text has): one for every byte of its words and blanks, which is the code's last byte."""
    one, at, _ = single_spaced(buf, starts, ends)
    edge = np.append(at, len(one))[bounds(counts)]
    codes = one.astype(U)
    for back in range(1, ORDER):
        before = np.full(len(one), START, np.uint8)
        before[back:] = one[:-back]
        early = edge[:-1, None] + np.arange(back)  # these reach out of their text
        before[early[early < edge[1:, None]]] = START
        codes |= before.astype(U) << U(8 * back)
    return codes, np.diff(edge)


def feeds(c, st: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts of a chunk can be prose."""
    letters, capitals = (np.diff(bounds(t[c.buf].astype(np.int64))[c.offs]) for t in (_LETTER, _CAPITAL))
    return ~st["base_failed"] & (st["n_symbols"] <= FEED_SYMBOLS * st["n_words"]) & (capitals <= FEED_CAPITALS * letters)


def _own(names: np.ndarray, n: np.ndarray):
    """(name, its texts, flags of their grams) for every name of a chunk."""
    for name in sorted(set(names.tolist())):
        mine = names == name
        yield name, mine, np.repeat(mine, n)


def count_grams(documents: DataFrame, model: str = "lang") -> DataFrame:
    """(lang, gram, n): 5-grams of the documents that can be prose, under the name in their column `model`. A task holds a million at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(name: str) -> pa.RecordBatch:
            codes, n = held.pop(name)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for rb in batches:
            names = np.array(rb.column("lang").to_pylist(), object)
            for c in chunks(rb.column("text"), CHUNK_BYTES):
                st = statistics(c)
                codes, n = packed(c.buf, *st["spans"], st["n_words"])
                fed = feeds(c, st)
                for name, mine, own in _own(np.where(fed, names[c.first : c.first + len(c)], ""), n):
                    if not (fed & mine).any():
                        continue
                    new, times = np.unique(codes[own], return_counts=True)
                    old, n_old = held.get(name, (np.zeros(0, U), np.zeros(0, np.int64)))
                    every, inverse = np.unique(np.concatenate([old, new]), return_inverse=True)
                    held[name] = every, np.bincount(inverse, np.concatenate([n_old, times]), len(every)).astype(np.int64)
                    if sum(len(x) for x, _ in held.values()) > 1_000_000:
                        for k in list(held):
                            yield out(k)
        for name in list(held):
            yield out(name)

    own = documents.select(F.col(model).cast("string").alias("lang"), "text").filter("lang is not null")
    return own.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted key arrays: log p of each seen gram of orders 1 to 5, and log back-off of each context."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, at, -1)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log p of the last byte of each 5-gram given the four before."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            if not len(todo):
                return out
            own = codes[todo] & U((1 << 8 * order) - 1)
            at = self._find(self.keys, key(own, order))
            hit = at >= 0
            out[todo[hit]] += self.logp[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if len(todo):
                at = self._find(self.contexts, key(own >> U(8), order - 1))
                out[todo] += np.where(at >= 0, self.backoff[at], 0.0)
        out[todo] += -np.log(256)
        return out


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


@dataclass
class Whole:
    """Of a language's whole table: counts of counts of orders 3 to 5, and the continuation counts of all byte pairs."""

    counts: dict[int, np.ndarray]
    pairs: np.ndarray


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 1, 2, and 3 and more (index 0 is 0), from the counts of counts."""
    c = [int(k) for k in counts]
    y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0.5
    d = [0.0]
    for k in (1, 2, 3):
        d.append(min(float(k), max(0.05, k - (k + 1) * y * c[k] / c[k - 1])) if c[k - 1] else 0.5 * k)
    return np.array(d)


def lower_orders(levels: dict[int, tuple[np.ndarray, np.ndarray]], least: int = 1) -> None:
    """Adds the orders below: in how many ways each shorter gram is preceded."""
    for order in range(min(levels) - 1, least - 1, -1):
        levels[order] = tuple(np.unique(levels[order + 1][0] & U((1 << 8 * order) - 1), return_counts=True))


def kneser_ney(codes: np.ndarray, n: np.ndarray, whole: Whole | None = None) -> Model:
    """The interpolated model from sorted 5-gram codes and counts; `whole` has what a part takes from all parts."""
    levels = {ORDER: (codes, n)}
    if whole:
        lower_orders(levels, 3)
        levels[2] = np.flatnonzero(whole.pairs).astype(U), whole.pairs[whole.pairs > 0]
    lower_orders(levels)
    keys, logp, contexts, backoff = [], [], [], []
    below_codes, below_p = np.zeros(1, U), np.array([1 / 256])
    for order in range(1, ORDER + 1):
        own, c = levels[order]
        d = _discounts(whole.counts[order] if whole and order > 2 else counts_of_counts(c))
        context, of = np.unique(own >> U(8), return_inverse=True)
        total = np.bincount(of, c, len(context))
        taken = d[np.minimum(c, 3)]
        weight = np.bincount(of, taken, len(context)) / total
        shorter = own & U((1 << 8 * (order - 1)) - 1)
        p = (c - taken) / total[of] + weight[of] * below_p[np.searchsorted(below_codes, shorter)]
        keys.append(key(own, order))
        logp.append(np.log(p))
        contexts.append(key(context, order - 1))
        backoff.append(np.log(np.maximum(weight, 1e-12)))
        below_codes, below_p = own, p
    k, c = np.concatenate(keys), np.concatenate(contexts)
    a, b = np.argsort(k), np.argsort(c)
    return Model(k[a], np.concatenate(logp)[a].astype(np.float32), c[b], np.concatenate(backoff)[b].astype(np.float32))


def _tables(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language → sorted 5-gram codes and their counts."""
    table = counted.toArrow()
    langs = table["lang"].to_numpy()
    codes, n = table["gram"].to_numpy().astype(U), table["n"].to_numpy()
    out = {}
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(codes[own])]
        out[lang] = codes[own], n[own]
    return out


def train(documents: DataFrame, model: str = "lang") -> dict[str, Model]:
    """The models by name, in one piece."""
    return {name: kneser_ney(*t) for name, t in _tables(count_grams(documents, model)).items()}


@dataclass
class Parts:
    """The models in broadcast parts; `names` are their languages."""

    shared: list
    names: frozenset

    @staticmethod
    def part(gram, n: int):
        """The part of a 5-gram, of integers in memory or in a column."""
        return (gram % (1 << 24) - gram % 256) * 40503 % 16777213 % n

    def score(self, name: str, codes: np.ndarray) -> np.ndarray:
        if len(self.shared) == 1:
            return self.shared[0].value[name].score(codes)
        out, part = np.zeros(len(codes)), self.part(codes.astype(np.int64), len(self.shared))
        for k, shared in enumerate(self.shared):
            own = np.flatnonzero(part == k)
            if len(own):
                out[own] = shared.value[name].score(codes[own])
                vars(shared).pop("_value", None)  # read again when needed: one part is held at a time
        return out


def train_parts(documents: DataFrame, most: int = PART_GRAMS, model: str = "lang") -> Parts:
    """The models by name, broadcast in parts of about `most` 5-grams."""
    share = documents.sparkSession.sparkContext.broadcast
    counted = cut(count_grams(documents, model))
    n = max(1, -(-counted.count() // most))
    if n == 1:
        models = {lang: kneser_ney(*t) for lang, t in _tables(counted).items()}
        return Parts([share(models)], frozenset(models))
    part = Parts.part(F.col("gram"), n)
    whole: dict[str, Whole] = {}
    for k in range(n):
        for lang, table in _tables(counted.filter(part == k)).items():
            own = whole.setdefault(lang, Whole({order: np.zeros(4, np.int64) for order in (3, 4, 5)}, np.zeros(1 << 16, np.int64)))
            levels = {ORDER: table}
            lower_orders(levels, 3)
            for order, (_, c) in levels.items():
                own.counts[order] += counts_of_counts(c)
            own.pairs += np.bincount((levels[3][0] & U(0xFFFF)).astype(np.int64), minlength=1 << 16)
    shared = []
    for k in range(n):
        tables = _tables(counted.filter(part == k))
        none = np.zeros(0, U), np.zeros(0, np.int64)
        shared.append(share({lang: kneser_ney(*tables.get(lang, none), w) for lang, w in whole.items()}))
    return Parts(shared, frozenset(whole))


def statistics(c) -> dict[str, np.ndarray]:
    """The base figures of a chunk's texts."""
    n = len(c)
    starts, ends, counts = words(c.buf, c.offs, NOT_SPACE)
    edge = bounds(counts)
    sums = lambda flags: np.diff(bounds(flags.astype(np.int64))[c.offs])
    lead = (c.buf & 0xC0) != 0x80
    chars = sums(lead & NOT_SPACE[c.buf])
    # Lines: spans between line feeds and text borders.
    feeds = np.flatnonzero(c.buf == 10)
    first = np.concatenate([c.offs[:-1], feeds + 1])
    last = np.concatenate([c.offs[1:], feeds])
    first, last = np.sort(first, kind="stable"), np.sort(last, kind="stable")
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[worded], last[worded]
    doc = np.searchsorted(c.offs, first, "right") - 1
    same = mix(span_hash(c.buf, first, last, LINE_SEED) + doc.astype(U) * U(0x9E3779B97F4A7C15))
    _, at = np.unique(same, return_index=True)
    lines = np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)
    # Words in repeated 3-word windows.
    h, at = grams(_TRI, span_hash(c.buf, starts, ends, WORD_SEED), counts, 3)
    own = np.searchsorted(edge, at, "right") - 1
    _, inverse, times = np.unique(mix(h + own.astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = at[times[inverse] > 1]
    hit = np.zeros(len(starts), bool)
    for k in range(3):
        hit[twice + k] = True
    repeated = np.diff(bounds(hit)[edge])
    failed = (counts < MIN_WORDS) | (100 * repeated > MAX_REPEAT * counts)
    return {"n_words": counts.astype(np.int64), "word_chars": chars, "n_symbols": sums(_SYMBOL[c.buf]), "n_dup_lines": lines.astype(np.int64), "n_repeat_words": repeated.astype(np.int64), "base_failed": failed, "spans": (starts, ends)}


def log_perplexity(c, names: np.ndarray, spans: tuple[np.ndarray, np.ndarray], counts: np.ndarray, models: Parts) -> np.ndarray:
    """Mean negative log-probability a byte of each text; NaN without words or model."""
    codes, n = packed(c.buf, *spans, counts)
    total, known = np.zeros(len(c)), np.zeros(len(c), bool)
    for name, mine, own in _own(names, n):
        if name in models.names and own.any():
            different, inverse = np.unique(codes[own], return_inverse=True)
            cost = -models.score(name, different)[inverse]
            total[mine] = np.bincount(np.repeat(np.arange(int(mine.sum())), n[mine]), cost, int(mine.sum()))
            known |= mine
    return np.divide(total, n, out=np.full(len(c), np.nan), where=known & (n > 0))


def _scored(texts: pa.Array, names: pa.Array, models: Parts) -> list[pa.Array]:
    names = np.array(names.to_pylist(), object)
    parts: list[list[np.ndarray]] = []
    for c in chunks(texts, CHUNK_BYTES if len(models.shared) == 1 else 4 * CHUNK_BYTES):
        st = statistics(c)
        ppl = log_perplexity(c, names[c.first : c.first + len(c)], st.pop("spans"), st["n_words"], models)
        parts.append([*st.values(), ppl])
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * len(kinds)
    return [pa.array(x, t, from_pandas=True) for x, t in zip(cols, kinds)]


def named(lang: Column) -> Column:
    """The name of a language: null has one too."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), lang.cast("string")))


METRICS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "log_ppl": "double"}


def score(documents: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of the documents, numbered, with METRICS, the language's name and the class of length behind them; stored."""
    names = documents.columns
    text, carried = names.index("text"), [names.index(c) for c in columns]
    language = named(F.col(f"c{names.index('lang')}"))
    fold = F.pmod(F.xxhash64(F.coalesce(f"c{text}", F.lit(""))), F.lit(2))
    model = lambda k: F.concat(language, F.lit("\n"), k.cast("string"))
    own = numbered(documents).select("*", language.alias("language"), model(1 - fold).alias("by"), model(fold).alias("fed"))
    shared = train_parts(own.select(F.col(f"c{text}").alias("text"), "fed"), model="fed")
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            cols = _scored(rb.column(text), rb.column(width + 1), shared)
            length = pa.array(np.searchsorted(LENGTHS, cols[0].to_numpy(), "right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(rb.column(k) for k in carried), *cols, rb.column(width), length], names=schema.names)

    schema = numbered(documents.select(*[F.col(f"`{c}`") for c in columns])).schema
    for name, kind in [*METRICS.items(), ("language", "string"), ("length", "integer")]:
        schema = schema.add(name, kind)
    return store(own.drop("fed").mapInArrow(run, schema))


def scaled(log_ppl, middle, n_words):
    return (log_ppl - middle) * F.sqrt(F.least(n_words, F.lit(FULL_WORDS)) / FULL_WORDS)


def quantiles(rows: DataFrame, keys: list[str], value: Column, times: Column | None = None, **shares: float) -> DataFrame:
    """Per key the values at these shares of its rows, from histograms in steps of 0.001; a row counts as often as `times` says."""
    hist = cut(rows.groupBy(*keys, F.round(value, 3).alias("v")).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("n")))  # so that no window reads what tasks counted each for themselves
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    placed = hist.select(*keys, "v", (upto / total).alias("share"))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("share") >= share - 1e-12, F.col("v"))).alias(k) for k, share in shares.items()])


def good_labels(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that all labels call good."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def bands(scored: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(language, length, middle, below, above, full): reach below and above the middle, and words of full length, of scored(doc_id, language, length, n_words, base_failed, log_ppl)."""
    usable = scored.filter("not base_failed and log_ppl is not null")
    lengths = F.explode(F.array(*[F.lit(k) for k in range(len(LENGTHS) + 1)])).alias("length")
    held = None
    if labels is not None:
        scores = usable.join(good_labels(labels), "doc_id", "left_semi").groupBy("language", "length", F.round("log_ppl", 3).alias("log_ppl"))
        good = cut(scores.agg(F.count(F.lit(1)).alias("times")))
        n = good.groupBy("language", "length").agg(F.sum("times").alias("n"))
        every = good.select("language").distinct().select("language", lengths).join(n, ["language", "length"], "left").fillna(0, ["n"])
        per = Window.partitionBy("language")
        small = F.sum(F.when(F.col("n") < LEAST_GOOD, F.col("n")).otherwise(0)).over(per)
        every = every.withColumns({"small": small, "total": F.sum("n").over(per)}).filter(F.col("total") >= LEAST_GOOD)
        alone = (F.col("n") >= LEAST_GOOD) & ~F.col("small").between(1, LEAST_GOOD - 1)
        group = cut(every.select("language", "length", F.when(alone, F.col("length")).otherwise(-1).alias("class")))
        at = quantiles(good.join(group, ["language", "length"]), ["language", "class"], F.col("log_ppl"), F.col("times"), low=(1 - KEPT) / 2, middle=0.5, high=(1 + KEPT) / 2)
        held = group.join(at, ["language", "class"]).select("language", "length", "middle", (F.col("middle") - F.col("low") + 0.0005).alias("below"), (F.col("high") - F.col("middle") + 0.0005).alias("above"), F.lit(1).alias("full"))
        held = cut(held)
        usable = usable.join(held.select("language").distinct(), "language", "left_anti")
    middle = cut(quantiles(usable, ["language"], F.col("log_ppl"), middle=0.5))
    off = F.abs(scaled(F.col("log_ppl"), F.col("middle"), F.col("n_words")))
    width = quantiles(usable.join(middle, "language"), ["language"], off, width=0.5)
    reach = F.greatest("width", F.lit(0.001))
    rest = middle.join(width, "language").select("language", lengths, "middle", (SPREAD_LOW * reach).alias("below"), (SPREAD_HIGH * reach).alias("above"), F.lit(FULL_WORDS).alias("full"))
    return cut(rest if held is None else rest.union(held))


def judged(documents: DataFrame, labels: DataFrame | None, columns: list[str]) -> DataFrame:
    """`score` with kept, perplexity, lower and upper."""
    scored = score(documents, columns)
    limits = bands(scored.withColumnRenamed(f"c{columns.index('doc_id')}", "doc_id"), labels)
    limits = F.broadcast(limits) if limits.count() <= MAX_BANDS else limits
    met = scored.join(limits, ["language", "length"], "left")
    size = F.sqrt(F.least(F.greatest("n_words", F.lit(1)), "full") / F.col("full"))
    low, high = F.coalesce(F.col("middle") - F.col("below") / size, F.lit(float("-inf"))), F.coalesce(F.col("middle") + F.col("above") / size, F.lit(float("inf")))
    inside = F.coalesce(F.col("log_ppl").between(low, high), F.lit(True))
    return met.withColumns({"kept": ~F.col("base_failed") & inside, "perplexity": F.exp("log_ppl"), "lower": F.exp(low), "upper": F.exp(high)})


def verdicts(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lower, upper); labels have (doc_id, quality 0 or 1)."""
    out = judged(documents.select("doc_id", "lang", "text"), labels, ["doc_id"])
    return out.select(F.col("c0").alias("doc_id"), *list(METRICS)[:-1], "kept", "perplexity", "lower", "upper")


def keep_good(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents that pass the base rules and their language's band, with all their columns.

    Texts are read once for the counts and once for the scores, which are stored with them.
    """
    out = judged(documents, labels, documents.columns).filter("kept")
    return out.select(*[f"c{k}" for k in range(len(documents.columns))]).toDF(*documents.columns)
