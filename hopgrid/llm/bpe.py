"""Exact BPE encoding by per-prefix dynamic programming.

BPE has one encoding for each prefix of a word, and it ends in one token. For every prefix the
automaton over the vocabulary (suffix links lead from each match to its shorter ones) gives the
tokens that end there; the one that may follow the last token of the prefix before it is stored.
Two tokens may stand side by side if no merge fires across their border while BPE builds them.
Back-pointers from the whole word give its ids. No merge list is ever replayed on a text.

Word encodings are kept in a bounded cache, so that a task's memory doesn't grow with its texts.

Defined cases: null is an empty text (no tokens, hashes of nothing); special tokens in a text are
their ids, as the library has it; repeated rows are answered row by row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hopgrid.llm.text import chunks

END = "\x01"
CACHE_WORDS = 400_000
FOREVER = 1 << 60
#: UTF-8 texts with all bytes below this one end before U+0540, where no two Unicode versions at hand differ.
OLD_BELOW = 0xD5


def byte_alphabet() -> list[str]:
    """One printable character per byte: itself if printable in Latin-1, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(0x100 + rest.index(b)) if b in set(rest) else chr(b) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a tokenizer file with word ends, byte alphabet and lower-casing."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.made.setdefault(self.vocab[a + b], (self.vocab[a], self.vocab[b], r))
        self.alphabet = byte_alphabet()
        self.machine = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        for t, i in self.vocab.items():
            form = t[: -len(self.suffix)] + END if t.endswith(self.suffix) and len(t) > len(self.suffix) else t
            self.machine.add_word(form, i)
            self.length[i] = len(form)
        self.machine.make_automaton()
        splits = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut_special = regex.compile(f"({splits})") if splits else None
        other, self.newer = self._newer_characters(path)
        letter, digit = rf"[\p{{L}}--[{other}]]", rf"[\p{{N}}--[{other}]]"
        #: The tokenizer file's own pattern, as it stands and with the characters that the versions differ on. Fixed value.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.odd = regex.compile(f"[{other}{''.join(map(chr, self.newer))}]")
        self.odd_pieces = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{other}]]+").findall
        self.spines: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
        self.pair_ok: dict[int, bool] = {}
        self.whole_ok: dict[int, bool] = {}
        self.cache: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def _newer_characters(path: str) -> tuple[str, dict[int, str]]:
        """Where the three Unicode versions at hand differ, the library's is asked: characters that it takes
        for neither letters nor digits but `regex` does (as a set's inside), and those that only it can lower."""
        split, lower = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, Tokenizer.from_file(path).normalizer.normalize_str
        unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
        newer = regex.findall(r"[\p{L}\p{N}]", unknown)
        other = [ord(c) for c in newer if len(split(":" + c)) == 1] + [0x10FFFF]
        ends = [k for k in range(len(other)) if k + 1 == len(other) or other[k + 1] != other[k] + 1]
        ranges = [(other[a + 1], other[b]) for a, b in zip([-1, *ends], ends)]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges), {ord(c): lower(c) for c in newer if lower(c) != c}

    def _spine(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """(part, born, gone): the parts at a token's right (left) border while it is built, by merge rank."""
        known = self.spines.get((token, right))
        if known is None:
            known, gone, part = [], FOREVER, token
            while part in self.made:
                a, b, r = self.made[part]
                known.append((part, r, gone))
                part, gone = b if right else a, r
            known.append((part, -1, gone))
            self.spines[token, right] = known
        return known

    def fires(self, first: int, second: int, before: int = FOREVER) -> bool:
        """Whether some merge joins the border of two neighbouring tokens (with a rank under `before`)."""
        rank = self.rank
        for x, born_x, gone_x in self._spine(first, True):
            for y, born_y, gone_y in self._spine(second, False):
                if born_x < gone_y and born_y < gone_x:
                    r = rank.get((x, y))
                    # At equal rank the left one of two overlapping pairs goes first.
                    if r is not None and r < gone_x and r <= gone_y and r < before:
                        return True
        return False

    def fits(self, first: int, second: int) -> bool:
        key = first << 32 | second
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) > 2_000_000:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = not self.fires(first, second)
        return ok

    def stands(self, token: int) -> bool:
        """Whether BPE makes this token from its own characters."""
        ok = self.whole_ok.get(token)
        if ok is None:
            if token not in self.made:
                ok = True
            else:
                a, b, r = self.made[token]
                ok = self.stands(a) and self.stands(b) and not self.fires(a, b, r)
            self.whole_ok[token] = ok
        return ok

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of a word in the byte alphabet, END included."""
        n = len(word)
        last: list[int] = [-1] * (n + 1)
        length, pair_ok, whole_ok = self.length, self.pair_ok.get, self.whole_ok.get
        for at, token in self.machine.iter(word):  # by end, so all prefixes before are settled
            if last[at + 1] >= 0:
                continue
            j = at + 1 - length[token]
            if j:
                before = last[j]
                if before < 0:
                    continue
                ok = pair_ok(before << 32 | token)
                if not (self.fits(before, token) if ok is None else ok):
                    continue
            ok = whole_ok(token)
            if self.stands(token) if ok is None else ok:
                last[at + 1] = token
        ids, i = [], n
        while i > 0:
            ids.append(last[i])
            i -= length[last[i]]
        return ids[::-1]

    def word(self, piece: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text) of one piece."""
        alphabet = self.alphabet
        ids = self.encode_symbols("".join([alphabet[b] for b in piece.encode()]) + END)
        out = np.array(ids, "<u4").tobytes(), " ".join([self.tokens[i] for i in ids])
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)  # white space stays: it only ever lies between pieces
        if not text.isascii():
            text = text.replace("Σ", "σ")
        return text.lower()  # letter by letter: no final form

    def parts(self, text: str, old: bool = False) -> list[tuple[bytes, str]]:
        """What each piece of a whole text gives, special tokens included. old: the text is known to hold no odd character."""
        out = []
        pieces = self.pieces
        if not old and self.odd.search(text):
            text, pieces = text.translate(self.newer), self.odd_pieces
        cached = self.cache.get
        for k, span in enumerate(self.cut_special.split(text)) if self.cut_special and "<" in text else ((0, text),):
            if k % 2:
                out.append((np.array([self.special[span]], "<u4").tobytes(), span))
            elif span:
                out += [cached(p) or self.word(p) for p in pieces(self.normal(span))]
        return out

    def encode(self, text: str, old: bool = False) -> tuple[bytes, str]:
        got = self.parts(text, old)
        return b"".join([a for a, _ in got]), " ".join([b for _, b in got])

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[int(i)] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder per worker process."""
    return WordBpe(path)


def encode(documents: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for every document; the file must be at `path` on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for rb in batches:
            for c in chunks(rb.column("text")):
                raw, shas, texts = [], [], []
                old = not len(c.buf) or int(c.buf.max()) < OLD_BELOW
                for i in range(len(c)):
                    ids, decoded = bpe.encode(c.text(i).decode("utf-8", "replace"), old)
                    raw.append(ids)
                    shas.append(hashlib.sha256(ids).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                n = np.array([len(x) // 4 for x in raw], np.int64)
                cols = [rb.column("doc_id").slice(c.first, len(c)), pa.array(n), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    values = np.frombuffer(b"".join(raw), "<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)
