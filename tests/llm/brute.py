"""What the operators must give, worked out plainly on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_dedup(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = [True] * length
            seen.add(w)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def substring_dedup(rows, window=13):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def windows_twice(w, size):
    count = Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
    hit = [False] * len(w)
    for j in range(len(w) - size + 1):
        if count[tuple(w[j : j + size])] > 1:
            hit[j : j + size] = [True] * size
    return sum(hit)


def longest_repeat(w):
    best = 0
    while best + 1 < len(w) and windows_twice(w, best + 1):
        best += 1
    return best


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    repeated, covered, longest = windows_twice(w, 5), windows_twice(w, 10), longest_repeat(w)
    failed = len(w) < 10 or 100 * repeated > 20 * len(w)
    kept = not failed and 100 * covered <= 20 * len(w) and longest <= 100
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(w), chars, symbols, len(lines) - len(set(lines)), repeated, covered, longest, failed, kept)


class Groups:
    def __init__(self, ids):
        self.of = {i: i for i in ids}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.of[b] = a


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    groups = Groups(sets)
    where = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                groups.join(i, j)
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


def near_vectors(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    groups, links = Groups([i for i, _ in rows]), Counter()
    ids = sorted(good)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            x, y = good[i], good[j]
            if len(x) == len(y) and (x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                groups.join(i, j)
                links[i] += 1
                links[j] += 1
    return {i: (links[i], groups.find(i), groups.find(i) == i) for i, _ in rows}


def edits(a, b):
    """Word edit distance."""
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def line_dedup(rows):
    earlier, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        gone = set()
        for k, line in enumerate([] if text is None else text.split("\n")):
            w = words(line)
            if len(w) < 5:
                continue
            if any(w == v or (min(len(w), len(v)) >= 5 and abs(len(w) - len(v)) < 2 and edits(w, v) < 2) for v in earlier):
                gone.add(k)
            earlier.append(w)
        lines = [] if text is None else text.split("\n")
        stay = [x for k, x in enumerate(lines) if k not in gone]
        emptied = bool(gone) and not any(words(x) for x in stay)
        out[i] = (len(lines), len(gone), emptied, None if text is None else "\n".join(stay))
    return out
