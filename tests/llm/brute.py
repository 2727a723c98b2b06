"""Plain versions of the operators, straight from their contracts."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def secrets(text):
    """(kind, start, end) of the base spans."""
    text = text or ""
    either = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def personal(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def contamination(docs, items):
    """Per (doc_id, text): (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("null" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def again(x):
    """A second hash of a hash: the finaliser of splitmix64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def fingerprint(text, words=3, k=0):
    """The k-th fingerprint: the first is of the hashes themselves."""
    w = WORD.findall(lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [again((x + k) % 2**64) for x in h] if k else h
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, limit=2, words=3, prints=1):
    """(doc_id, fingerprint, component_id) per document; any of the fingerprints can link."""
    every = [np.array([fingerprint(t, words, k) for _, t in docs], np.uint64) for k in range(prints)]
    f = every[0]
    up = list(range(len(f)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(f)):
        near = np.any([np.bitwise_count(g ^ g[i]) <= limit for g in every], axis=0)
        for j in np.flatnonzero(near).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    ids = {}
    for i in range(len(f)):
        if docs[i][0] is not None:
            ids[root(i)] = min(ids.get(root(i), docs[i][0]), docs[i][0])
    return [(docs[i][0], f"{int(f[i]):016x}", ids.get(root(i))) for i in range(len(f))]


def repeats(sequences, size):
    """Per sequence, flags of the units under a window that starts elsewhere too."""
    c = Counter(tuple(s[k : k + size]) for s in sequences for k in range(len(s) - size + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - size + 1):
            if c[tuple(s[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append(gone)
    return out


def removed_bytes(docs, size=200):
    raw = [(t or "").encode() for _, t in docs]
    out = []
    for (d, _), b, gone in zip(docs, raw, repeats(raw, size)):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def removed_words(docs, size=35):
    split = [WORD.findall(t or "") for _, t in docs]
    return [(d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))) for (d, _), w, gone in zip(docs, split, repeats(split, size))]


def field_spans(field, text, trim=":.,;()\"'"):
    """(kind, start, end) of the model's spans: a line at a time, one word after another, no screen. Bytes of words are turned to weights one by one."""
    from hopgrid.llm import pii

    out, base = [], personal(text)
    for line in re.finditer("[^\n]+", text):
        found = [(m.start() + line.start(), m[0]) for m in WORD.finditer(line[0])]
        if not found:
            continue
        ids = []
        for _, w in found:
            raw = np.frombuffer(w.encode(), np.uint8)
            ids.append([int(x[0]) for x in field.ids(pii.word_keys(raw, np.array([0]), np.array([len(raw)])))])
        score, back = None, []
        for t in range(len(found)):
            em = np.zeros(len(pii.LABELS))
            for (k, d), w in field.weights.items():
                em += w[ids[t + d][k] if 0 <= t + d < len(found) else 0]
            em[0] += pii.BIAS
            if score is None:
                score = em
            else:
                step = score[:, None] + field.trans
                back.append(step.argmax(0))
                score = step.max(0) + em
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        path = path[::-1]
        t = 0
        while t < len(path):
            e = t
            while e + 1 < len(path) and path[e + 1] == path[t]:
                e += 1
            kind = {1: "name", 2: "local", 3: "id"}.get(path[t])
            words = [w for _, w in found[t : e + 1]]
            odd = len(words) > 5 or len(set(words)) < len(words) or any(re.match(r"[(\"']*[a-z]", w) for w in (words[0], words[-1])) or any(re.search(r"..\.$", w) for w in words[:-1])
            before = WORD.findall(text[: found[t][0]])
            odd = odd or len(words) == 1 and not (before and before[-1].lower() in pii.ADDRESS)
            if kind and not (kind == "name" and odd):
                a, b = found[t][0], found[e][0] + len(found[e][1])
                while a < b and text[a] in trim and text[a] != "(":
                    a += 1
                while b > a and text[b - 1] in trim:
                    b -= 1
                if b - a >= 4 and not any(x < b and a < y for _, x, y in base):
                    out.append((kind, a, b))
            t = e + 1
    return out


def redacted(text, spans):
    order = ("email", "ip", "card", "phone", "name", "local", "id")
    out, done = "", 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], order.index(x[0]), x[2])):
        if s >= done:
            out += text[done:s] + f"[{k.upper()}]"
        done = max(done, e)
    return out + text[done:]
