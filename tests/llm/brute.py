"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict


def shingles(text, words=5):
    tokens = (text or "").lower().split()
    width = min(words, len(tokens))
    return {tuple(tokens[i: i + width]) for i in range(len(tokens) - width + 1)} if tokens else set()


def similar(rows, limit=0.8):
    """``rows`` of (doc_id, text): per row class_id, class_size, n_links."""
    sets = [shingles(text) for _, text in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= limit * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        own = members[find(i)]
        least = min((rows[m][0] for m in own if rows[m][0] is not None), default=None)
        out.append((doc_id, least, len(own), links[i]))
    return out


def fold(doc_id, folds):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def factors(seen, k=5):
    for top in range(k, 0, -1):
        n = [seen.get(r, 0) for r in range(top + 2)]
        if all(n[1:]):
            common = (top + 1) * n[top + 1] / n[1]
            if common < 1:
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, top + 1)}
                if all(0 < v < 1 for v in d.values()):
                    return d
    return {}


class Katz:
    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            words = tokens(text)
            self.one.update(words)
            for before, word in zip([None, *words], words, strict=False):
                self.two[before][word] += 1
        self.total = sum(self.one.values())
        self.d1 = factors(Counter(self.one.values()))
        self.d2 = factors(Counter(n for c in self.two.values() for n in c.values()))
        lost = sum((1 - self.d1.get(n, 1)) * n for n in self.one.values())
        self.scale = self.total if lost > 0 else self.total + 1
        self.unknown = (lost if lost > 0 else 1) / self.scale if self.total else 1.0

    def single(self, word):
        n = self.one.get(word, 0)
        return n * self.d1.get(n, 1) / self.scale if n else self.unknown

    def pair(self, before, word):
        seen = self.two.get(before)
        if not seen:
            return self.single(word)
        total = sum(seen.values())
        kept = sum(n * self.d2.get(n, 1) for n in seen.values())
        scale = total if total - kept > 1e-9 else total + 1
        if word in seen:
            return seen[word] * self.d2.get(seen[word], 1) / scale
        free = (scale - kept) / scale
        return free * self.single(word) / (1 - sum(self.single(w) for w in seen))

    def score(self, text):
        words = tokens(text)
        return sum(math.log10(self.pair(b, w)) for b, w in zip([None, *words], words, strict=False))

    def base(self, text):
        return sum(
            math.log10((self.one.get(w, 0) + 0.1) / (self.total + 0.1 * (len(self.one) + 1))) for w in tokens(text))
