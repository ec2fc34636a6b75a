"""Brute-force versions of the operators, in plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(t):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    """{id: (size, links, component)}."""
    sets = {i: shingle_set(t) for i, t in rows}
    lists, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for e in s:
            lists[e].append(i)
    for ids in lists.values():
        common.update(itertools.combinations(sorted(ids), 2))
    degree, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), k in common.items():
        if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            degree[a] += 1
            degree[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), degree[i], find(i)) for i, s in sets.items()}


def quality(t):
    """(words, word_chars, symbols, duplicate lines, repeated words)."""
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def secrets(t):
    """Spans (start, kind, end) of the fixed kinds, sorted."""
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def masked(t, spans, mask="[secret]"):
    """The text with spans (start, end) replaced, overlapping ones together."""
    merged = []
    for a, z in sorted(spans):
        if merged and merged[-1][1] > a:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    for a, z in reversed(merged):
        t = t[:a] + mask + t[z:]
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def licenses(t):
    """(words, [(first word, label)])."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    base = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
    return len(w), sorted((i, x) for p, x in base for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
