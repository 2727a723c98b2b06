"""Secret scan with an assignment-aware lexer.

Fixed patterns give the base spans (assign, access, hex). The lexer reads source and configuration
syntax into tokens, pairs each target name with the literal it gets (`name = "x"`, `"name": 'x'`,
`name: x`, `name := x`, `NAME=x`, `<name>x</name>`, `name="name" value="x"`), follows names that were
given a constant before (`a = "x"` ... `password = a`) and joined parts (`"x" + a`), and scores each
literal by how random it looks and how sensitive the names are that it ends up in. Constants are kept
as references, not copied, so the work is linear in the text. Literals at or above THRESHOLD are added
as kind `literal`. An apostrophe within a word opens no string.

A line that opens with '#' or '//' is a comment and skipped. Further on in a line these are comment
marks only after white space, and the comment's text is lexed for pairs as well.

Byte-level screens (vectorised) decide which texts can hold a span at all; only these are lexed.
A screen only passes a text on or not where no pattern could match, so it never loses a span.

Defined cases: null is an empty text without spans; offsets are code points of the whole text, end
exclusive; repeated rows are answered row by row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopgrid.llm.text import LOWER, byte_class, chunks

#: Fixed patterns of the contract. Only ASCII letters count in either case.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Sensitive parts of target names and their weights.
NAME_WEIGHTS = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "privatekey": 3.0, "accesskey": 3.0, "secretkey": 3.0, "authkey": 2.5, "signingkey": 2.5, "encryptionkey": 2.5, "bearer": 2.0, "auth": 1.0, "key": 1.0}
#: A stem of each name above: a text with none of them has no sensitive target.
STEMS = re.compile(rb"pass|pwd|secret|token|api|cred|key|auth|bearer")
THRESHOLD = 4.0
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.+|<.*>|\$\{.*|\$[a-z_]+|%.*%|your[-_ ]?.*|change[-_]?me|example|dummy|none|null|true|false|todo|test)$")
_HEX = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)

TOKEN = re.compile(
    r"""
    (?P<comment>(?m:^)[^\S\n]*(?:\#|//)[^\n]*)
  | (?P<mark>(?<=\s)(?:\#|//))
  | (?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
  | (?P<op>:=|=>|==+|!=|<=|>=|[=:])
  | (?P<name>[A-Za-z_][A-Za-z0-9_.-]*)
  | (?P<bare>[A-Za-z0-9+/_.=~-]+)
  | (?P<line>\n)
  | (?P<space>[^\S\n]+)
  | (?P<other>.)
    """,
    re.X | re.S,
)
#: Mark-up that gives a name a literal. Every part ends at the next mark, so scanning stays linear.
ELEMENT = re.compile(r"<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>(?P<value>[^<>\n]+)</(?P=tag)>")
NAMED = re.compile(r"""\b(?:name|key)=(?P<q>["'])(?P<name>[^"'<>\n]+)(?P=q)\s{1,8}value=(?P<p>["'])(?P<value>[^"'<>\n]+)(?P=p)""")
ASSIGNS = {"=", ":", ":=", "=>"}
BARE_VALUE = re.compile(r"[A-Za-z0-9+/_.=~-]+")
PREFIXES = {"b", "f", "r", "u", "br", "rb", "fr", "rf"}
#: Words that stand before a name without being one.
KEYWORDS = {"export", "const", "let", "var", "final", "static", "public", "private", "set", "string", "str", "val", "char"}


def name_parts(name: str) -> list[str]:
    """Lower-case parts of an identifier: snake, kebab, dotted and camel case."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def sensitivity(name: str) -> float:
    """Weight of a target name: its best part, or pair of neighbouring parts joined (api + key, pass + word)."""
    parts = name_parts(name)
    joined = parts + [a + b for a, b in zip(parts, parts[1:]) if b == "key" or a == "pass"]
    return max([NAME_WEIGHTS.get(p, 0.0) for p in joined], default=0.0)


def randomness(value: str) -> float:
    """0 to 3 by bits a character, mixed classes and length; negative for placeholders and short values."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return -9.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.5, bits / 2.5) + 0.5 * (classes > 1) + 0.5 * (n >= 12) + 0.5 * (n >= 20) - 1.5 * (" " in value)


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, token, start, end). A mark after white space opens a comment, whose own text is lexed up to the line's end, so that no string runs out of it.

    An apostrophe right behind a letter or digit opens no string, unless these are a string's prefix
    (b, f, r, u). Where a quote finds no end, no later one of its kind on that line does either
    (escapes pair up alike from both), so none is tried again and lexing stays linear.
    """
    out, at, stop = [], 0, len(text)
    dead = dict.fromkeys("\"'`", 0)
    while at < len(text):
        c = text[at]
        if c in dead:
            prefix = c == "'" and bool(out) and out[-1][3] == at and out[-1][1].lower() in PREFIXES
            if at < dead[c] or c == "'" and at and (text[at - 1].isalnum() or text[at - 1] == "_") and not prefix:
                out.append(("other", c, at, at + 1))
                at += 1
                continue
        m = TOKEN.match(text, at, stop)
        if c in dead:
            if m.lastgroup != "string":
                line = stop if c == "`" else text.find("\n", at, stop)
                dead[c] = line if line >= 0 else stop
            elif prefix:
                out.pop()
        if m.lastgroup == "mark" and stop == len(text):
            line = text.find("\n", at)
            stop = line if line >= 0 else stop
        if m.lastgroup not in ("space", "comment"):
            out.append((m.lastgroup, m.group(), m.start(), m.end()))
        at = m.end()
        if at == stop:
            stop = len(text)
    return out


@dataclass
class Assignment:
    """A target name, the literals (text, start, end) it gets, and the assignments whose constants it gets."""

    target: str
    literals: list[tuple[str, int, int]]
    constants: list[int]


def assignments(text: str) -> list[Assignment]:
    """All assignments in order; a name stands for what it was last given."""
    toks = tokens(text)
    latest: dict[str, int] = {}
    out: list[Assignment] = []
    for k in range(1, len(toks) - 1):
        kind, op, _, _ = toks[k]
        if kind != "op" or op not in ASSIGNS:
            continue
        tk, target, _, _ = toks[k - 1]
        if tk == "string":
            target = target[1:-1]
        elif tk != "name" or target in KEYWORDS:
            continue
        got = Assignment(target, [], [])
        j = k + 1
        while j < len(toks):
            vk, value, s, e = toks[j]
            if vk == "string":
                got.literals.append((value[1:-1], s + 1, e - 1))
            elif vk == "name" and value in latest:
                got.constants.append(latest[value])
            elif vk in ("name", "bare"):
                m = BARE_VALUE.match(text, s)
                if m and not (j + 1 < len(toks) and toks[j + 1][1] == "("):
                    got.literals.append((m.group(), s, m.end()))
            else:
                break
            if j + 2 < len(toks) and toks[j + 1][1] == "+":
                j += 2
            else:
                break
        if got.literals or got.constants:
            latest[target] = len(out)
            out.append(got)
    return out


def elements(text: str) -> list[Assignment]:
    """Literals that mark-up gives a name: an element's text, or a value beside a name."""
    out = [Assignment(m["tag"], [(m["value"], m.start("value"), m.end("value"))], []) for m in ELEMENT.finditer(text)]
    return out + [Assignment(m["name"], [(m["value"], m.start("value"), m.end("value"))], []) for m in NAMED.finditer(text)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the literals that sensitive names are given, by themselves or through constants."""
    steps = assignments(text)
    weight = [sensitivity(a.target) for a in steps]
    for k in range(len(steps) - 1, -1, -1):  # constants come before those that use them
        for c in steps[k].constants:
            weight[c] = max(weight[c], weight[k])
    named = elements(text) if "</" in text or "value" in text else []
    given = zip(steps + named, weight + [sensitivity(a.target) for a in named])
    return sorted({(s, 3, e) for a, w in given if w for value, s, e in a.literals if w + randomness(value) >= THRESHOLD})


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def screen(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts may hold any span: a hex run, an access key, or a sensitive stem beside an assignment sign or mark-up."""

    def texts_at(at: np.ndarray, offs: np.ndarray = offs) -> np.ndarray:
        out = np.zeros(len(offs) - 1, bool)
        out[np.searchsorted(offs, at, "right") - 1] = True
        return out

    edge = np.diff(np.concatenate(([0], _HEX[buf].view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_runs = [np.append(np.arange(s, e, 16), e - 1) for s, e in zip(start[end - start >= 24], end[end - start >= 24])]
    parted = offs + np.arange(len(offs))  # a byte that no stem holds stands between texts
    low = np.insert(LOWER[buf], offs[1:-1], 0).tobytes()
    keys = np.array([m.start() for m in re.finditer(rb"akia", low)], np.int64)
    stems = np.array([m.start() for m in STEMS.finditer(low)], np.int64)
    signs = np.flatnonzero((buf == 0x3D) | (buf == 0x3A) | (buf == 0x3C))
    return texts_at(np.concatenate([np.zeros(0, np.int64), *long_runs])) | texts_at(keys, parted) | texts_at(stems, parted) & texts_at(signs)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) for every document."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            counts = np.zeros((rb.num_rows, 4), np.int64)
            sha, spans = [empty] * rb.num_rows, [""] * rb.num_rows
            for c in chunks(rb.column("text")):
                for i in np.flatnonzero(screen(c.buf, c.offs)):
                    text = c.text(i).decode("utf-8", "replace")
                    base = base_spans(text)
                    every = base + literal_spans(text)
                    row = c.first + int(i)
                    for _, k, _ in every:
                        counts[row, k] += 1
                    sha[row] = hashlib.sha256(render(base).encode()).hexdigest()
                    spans[row] = render(every)
            cols = [pa.array(counts[:, k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *cols[:3], pa.array(sha, pa.string()), pa.array(spans, pa.string()), cols[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")
