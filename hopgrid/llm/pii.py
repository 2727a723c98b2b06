"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans (email, ip, card, phone). The field labels each word as O, NAME,
PHONE, ID or BASE (what the patterns cover) from its shape, its neighbours' shapes and cue words; it
is trained by gradient ascent on a small labelled table (`pii_table`: a fixed set of sentences in four
languages, whatever the corpus), on the driver and once a session, and decoded by Viterbi over whole
lines in numpy batches.
Its NAME, PHONE and ID runs that touch no base span are added as kinds name, local, id.

A line is only decoded if some word's best label could beat O by more than any transition gains;
else the Viterbi path is all O, so skipping it loses nothing.

Defined cases: null is an empty text without spans; offsets are code points, end exclusive; lines
end at \\n; repeated rows are answered row by row; `redact` keeps null texts null and recounts n_chars.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.llm.pii_table import ADDRESS, FIRST, LABELS, labelled_table
from hopgrid.llm.text import LOWER, NOT_SPACE, bounds, byte_class, chunks, numbered, span_hash, words

KINDS = ("email", "ip", "card", "phone", "name", "local", "id")
#: Fixed patterns of the contract, with guards that keep scanning linear and change no match.
LOCAL_PART = byte_class(lambda b: chr(b).isascii() and (chr(b).isalnum() or chr(b) in "._%+-"))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Per @: the run of local characters before it (not before the last match's end), and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and ord(text[s - 1]) < 128 and LOCAL_PART[ord(text[s - 1])]:
            s -= 1
        m = DOMAIN.match(text, at + 1)
        if s < at and m:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; a match that fails its test is dropped."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() <= 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return found


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


#: Added to O's score in decoding: a span must be this much better than none.
BIAS = 0.5


# --- features -------------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.uint8)
for _chars, _id in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3)):
    _CLASS[[ord(c) for c in _chars]] = _id
for _id, _c in enumerate("@.-()+/:,;'\"&%#!?|=_*$", 5):
    _CLASS[ord(_c)] = _id
_CLASS[128:] = 1
SHAPE_SEED, EXACT_SEED, CUE_SEED = 81, 82, 83
_TRIM = byte_class(lambda b: chr(b) in ":.,;()\"'")
_CUE_TRIM = byte_class(lambda b: chr(b) in ";()\"'")  # "name:" and "name", "from" and "from." are different cues
CONTEXT = (-2, -1, 0, 1, 2)


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per word: hashes of its collapsed shape, of its exact shape with length, and of its lower-case letters (a cue)."""
    classes = _CLASS[buf]
    exact = span_hash(classes, starts, ends, EXACT_SEED)
    turn = np.empty(len(buf), bool)
    turn[:1] = True
    turn[1:] = classes[1:] != classes[:-1]
    turn[starts] = True
    at = np.flatnonzero(turn)
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
    shape = span_hash(classes[at], lo, hi, SHAPE_SEED) if len(at) else np.zeros(0, np.uint64)
    e = ends.copy()
    for _ in range(2):  # trailing marks don't belong to a cue
        e -= (e - starts > 1) & _CUE_TRIM[buf[np.maximum(e - 1, 0)]]
    return [shape, exact, span_hash(LOWER[buf], starts, e, CUE_SEED)]


def _spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(text.encode(), np.uint8)
    return buf, *words(buf, np.array([0, len(buf)]), NOT_SPACE)[:2]


class Field:
    """Weights: per key kind and context offset a table over the keys seen in training (row 0: unseen), and transitions."""

    def __init__(self, table: list[tuple[str, list[int]]], rounds: int = 200, rate: float = 0.25, decay: float = 5e-4):
        text = "\n".join(s for s, _ in table).encode()
        buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        starts, ends, _ = words(buf, offs, NOT_SPACE)
        gold = np.array(list(itertools.chain.from_iterable(y for _, y in table)))
        sizes = np.array([len(y) for _, y in table])
        keys = word_keys(buf, starts, ends)
        self.known = [np.unique(k) for k in keys]
        # Cues are only words of the table that stand up to two before or one after a labelled one, and known first names; others count as unseen.
        line = np.repeat(np.arange(len(sizes)), sizes)
        first = np.unique(span_hash(*_spans(" ".join(FIRST).lower()), CUE_SEED))
        near = (gold == LABELS.index("NAME")) & np.isin(keys[2], first)
        for d in (1, 2, -1):
            near |= (self._shift((gold > 0).astype(np.int32), d, line) > 0) & (gold == 0)
        self.known[2] = np.unique(keys[2][near])
        n = len(LABELS)
        self.weights = {(k, d): np.zeros((len(self.known[k]) + 1, n)) for k in range(3) for d in CONTEXT if k == 2 or abs(d) <= 1}
        self.trans = np.zeros((n, n))
        self._fit(keys, gold, sizes, rounds, rate, decay)

    def ids(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """1 + position among the known keys, 0 if unseen."""
        out = []
        for known, k in zip(self.known, keys):
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            out.append(np.where(known[at] == k, at + 1, 0).astype(np.int32))
        return out

    @staticmethod
    def _shift(ids: np.ndarray, d: int, line: np.ndarray) -> np.ndarray:
        """The neighbour's id at distance d in the same line, else 0."""
        if d == 0:
            return ids
        out = np.zeros_like(ids)
        if len(ids) <= abs(d):
            return out
        a, b = (slice(0, -d), slice(d, None)) if d > 0 else (slice(-d, None), slice(0, d))
        out[a] = np.where(line[a] == line[b], ids[b], 0)
        return out

    def emissions(self, ids: list[np.ndarray], line: np.ndarray) -> np.ndarray:
        out = np.zeros((len(line), len(LABELS)), np.float32)
        for (k, d), w in self.weights.items():
            out += w.astype(np.float32)[self._shift(ids[k], d, line)]
        return out

    def _fit(self, keys, gold, sizes, rounds, rate, decay) -> None:
        line = np.repeat(np.arange(len(sizes)), sizes)
        ids = self.ids(keys)
        n, t_max, rows = len(LABELS), int(sizes.max()), len(sizes)
        col = np.arange(len(line)) - np.repeat(bounds(sizes)[:-1], sizes)
        mask = np.zeros((rows, t_max), bool)
        mask[line, col] = True
        target = np.zeros((len(line), n))
        target[np.arange(len(line)), gold] = 1
        same = line[1:] == line[:-1]
        want = np.zeros((n, n))
        np.add.at(want, (gold[:-1][same], gold[1:][same]), 1)
        fast = {k: np.zeros_like(v) for k, v in [*self.weights.items(), ("t", self.trans)]}
        for _ in range(rounds):
            em = np.zeros((rows, t_max, n))
            em[line, col] = self.emissions(ids, line)
            fwd, bwd = np.zeros_like(em), np.zeros_like(em)
            fwd[:, 0] = em[:, 0]
            for t in range(1, t_max):
                fwd[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + self.trans, axis=1) + em[:, t], fwd[:, t - 1])
            for t in range(t_max - 2, -1, -1):
                step = np.logaddexp.reduce(self.trans + (em[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            prob = np.exp(fwd + bwd - z[:, None, None])[line, col]
            pair = np.exp(fwd[:, :-1, :, None] + self.trans + (em + bwd)[:, 1:, None, :] - z[:, None, None, None])
            slope = {"t": want - (pair * mask[:, 1:, None, None]).sum((0, 1))}
            for (k, d), w in self.weights.items():
                g = np.zeros_like(w)
                np.add.at(g, self._shift(ids[k], d, line), target - prob)
                slope[k, d] = g
            for name, w in [*self.weights.items(), ("t", self.trans)]:  # steps scaled by the gradients so far
                g = slope[name] - decay * len(sizes) * w
                fast[name] += g * g
                w += rate * g / (1e-6 + np.sqrt(fast[name]))

    def viterbi(self, em: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of consecutive lines of `sizes` words, longest lines first, one step for all at a time."""
        out = np.zeros(len(em), np.int8)
        at = bounds(sizes)[:-1]
        order = np.argsort(-sizes, kind="stable")
        first, count = at[order], sizes[order]
        alive = len(order)
        trans = self.trans.astype(np.float32)
        score = em[first].copy()
        back = [np.zeros((alive, len(LABELS)), np.int8)]
        for t in range(1, int(count[0]) if alive else 0):
            alive = int(np.searchsorted(-count, -t, "left"))  # lines longer than t
            step = score[:alive, :, None] + trans
            from_ = step.argmax(1).astype(np.int8)
            score[:alive] = np.take_along_axis(step, from_[:, None, :].astype(np.int64), 1)[:, 0] + em[first[:alive] + t]
            back.append(from_)
        best = score.argmax(1)
        for t in range(len(back) - 1, -1, -1):
            alive = int(np.searchsorted(-count, -t, "left"))
            out[first[:alive] + t] = best[:alive]
            if t:
                best[:alive] = back[t][np.arange(alive), best[:alive]]
        return out

    def label(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, counts per text, labels) of all words."""
        starts, ends, counts = words(buf, offs, NOT_SPACE)
        labels = np.zeros(len(starts), np.int8)
        if not len(starts):
            return starts, ends, counts, labels
        breaks = np.flatnonzero(buf == 10)
        doc = np.repeat(np.arange(len(counts)), counts)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(np.searchsorted(breaks, starts)) > 0) | (np.diff(doc) > 0)
        line = np.cumsum(new) - 1
        em = self.emissions(self.ids(word_keys(buf, starts, ends)), line)
        em[:, 0] += BIAS
        gain = float(self.trans.max() - self.trans[0, 0])
        open_ = em[:, 1:].max(1) + 2 * gain >= em[:, 0]
        pick = np.zeros(line[-1] + 1, bool)
        pick[line[open_]] = True
        chosen = pick[line]
        if chosen.any():
            sizes = np.bincount(line[chosen], minlength=len(pick))
            labels[chosen] = self.viterbi(em[chosen], sizes[sizes > 0])
        return starts, ends, counts, labels


@lru_cache(maxsize=1)
def field() -> Field:
    """The trained field. It is sent to the tasks with their function (its size is the table's, not the corpus's)."""
    return Field(labelled_table())


NAME_WORDS = 5
SPAN_KIND = {1: 4, 2: 5, 3: 6}


def name_like(own: list[bytes]) -> bool:
    """A name is short, repeats no word, begins and ends with words that have no small initial, and only one letter in it ends in a full stop."""
    small = any(b"a" <= w.lstrip(b"(\"'")[:1] <= b"z" for w in (own[0], own[-1]))
    return len(own) <= NAME_WORDS and len(set(own)) == len(own) and not small and not any(w.endswith(b".") and len(w) > 2 for w in own[:-1])


def find_spans(c, model: Field | None = None) -> list[tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(text's index, base spans, all spans) for the texts of a chunk that have any."""
    starts, ends, counts, labels = (model or field()).label(c.buf, c.offs)
    edge = bounds(counts)
    special = (c.buf == 0x40) | (c.buf == 0x2B)
    digit = (c.buf >= 0x30) & (c.buf <= 0x39)
    has = np.zeros(len(c), bool)
    for at in (np.flatnonzero(special), np.flatnonzero(digit)):
        has[np.searchsorted(c.offs, at, "right") - 1] = True
    tagged = np.flatnonzero(np.isin(labels, list(SPAN_KIND)))
    has[np.searchsorted(edge, tagged, "right") - 1] = True
    out = []
    for i in np.flatnonzero(has):
        raw = c.text(i)
        base = base_spans(raw.decode("utf-8", "replace"))
        every = list(base)
        own = tagged[np.searchsorted(tagged, edge[i]) : np.searchsorted(tagged, edge[i + 1])]
        for run in np.split(own, np.flatnonzero((np.diff(own) > 1) | (np.diff(labels[own]) != 0)) + 1) if len(own) else ():
            s, e = int(starts[run[0]] - c.offs[i]), int(ends[run[-1]] - c.offs[i])
            while s < e and _TRIM[raw[s]] and raw[s] != 0x28:
                s += 1
            while e > s and _TRIM[raw[e - 1]]:
                e -= 1
            a, b = len(raw[:s].decode("utf-8", "replace")), len(raw[:e].decode("utf-8", "replace"))
            own_words = [raw[x:y] for x, y in zip(starts[run] - c.offs[i], ends[run] - c.offs[i])]
            if labels[run[0]] == LABELS.index("NAME") and not name_like(own_words):
                continue
            if labels[run[0]] == LABELS.index("NAME") and len(run) == 1 and (run[0] == edge[i] or raw[starts[run[0] - 1] - c.offs[i] : ends[run[0] - 1] - c.offs[i]].decode("utf-8", "replace").lower() not in ADDRESS):
                continue
            if b - a >= 4 and not any(x < b and a < y for x, _, y in base):
                every.append((a, SPAN_KIND[int(labels[run[0]])], b))
        if every:
            out.append((int(i), base, every))
    return out


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model) for every document."""
    empty, model = hashlib.sha256(b"").hexdigest(), field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            counts = np.zeros((rb.num_rows, len(KINDS)), np.int64)
            sha, spans = [empty] * rb.num_rows, [""] * rb.num_rows
            for c in chunks(rb.column("text")):
                for i, base, every in find_spans(c, model):
                    row = c.first + i
                    for _, k, _ in every:
                        counts[row, k] += 1
                    sha[row] = hashlib.sha256(render(base).encode()).hexdigest()
                    spans[row] = render(every)
            cols = [pa.array(counts[:, k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), *cols, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts[:, 4:].sum(1))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_model"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping ones, replaced by its first kind."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text, and n_chars recounted where there is one."""
    own, at, model = numbered(documents), documents.columns.index("text"), field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            changed: dict[int, str] = {}
            column = rb.column(at)
            for c in chunks(column):
                for i, _, every in find_spans(c, model):
                    changed[c.first + i] = redacted(c.text(i).decode("utf-8", "replace"), every)
            if changed:
                column = column.to_pylist()
                for i, t in changed.items():
                    column[i] = t
                column = pa.array(column, rb.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if k == at else x for k, x in enumerate(rb.columns)], names=rb.schema.names)

    out = own.mapInArrow(run, own.schema)
    if "n_chars" in documents.columns:
        n = f"c{documents.columns.index('n_chars')}"
        out = out.withColumn(n, F.length(f"c{at}").cast(own.schema[n].dataType))
    return out.toDF(*documents.columns)
