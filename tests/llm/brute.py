"""Plain restatements of the operators over a list of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

NULL_FIRST = lambda i: (i is not None, i or 0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base_figures(text):
    w = words(text)
    grams, covered, seen, dup = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set(), set(), 0
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            covered |= set(range(k, k + 5))
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def fingerprint(text, n=3):
    w = words(lower(text))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(docs, bits=2, n=3):
    fps = [fingerprint(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)].append(i)
    return sorted(((i, fps[a], min(least[find(a)], default=None)) for a, (i, _) in enumerate(docs)), key=str)


def contamination(docs, items, window=10):
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])] |= set() if i is None else {str(i)}
    out = []
    for i, t in docs:
        w, hit, found = pattern.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def line_dedup(docs, points=10):
    key, holders = lambda x: lower(x.strip(" \t\n\x0b\x0c\r")), defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < points or len(holders[key(x)]) < 2 or min(holders[key(x)], key=NULL_FIRST) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def substring_dedup(docs, window=20):
    order = sorted({(NULL_FIRST(i), zlib.crc32(t.encode()) if t is not None else 0, t or "") for i, t in docs})
    first, out = {}, []
    for d, tag, t in order:
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (d, tag, k))
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (NULL_FIRST(i), zlib.crc32(t.encode()), k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def tokens(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")
