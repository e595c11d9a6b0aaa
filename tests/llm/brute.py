"""Plain versions of the operators, for small inputs."""

import hashlib
import math
from collections import Counter, defaultdict

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(texts):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, u = defaultdict(list), Union()
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for g in s:
            holders[g].append(i)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def without_repeats(texts, window=200):
    """[(n_bytes, n_removed, n_spans, sha256 of what stays)] of a list of texts."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def backoff_scores(texts, order=3, least=2, alpha=0.4):
    tokens = [words(t) for t in texts]
    count = Counter(tuple(w[k : k + n]) for w in tokens for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(map(len, tokens))

    def log_score(w, i):
        lost = 0.0
        for n in range(min(order, i + 1), 1, -1):
            c = count[tuple(w[i - n + 1 : i + 1])]
            if c >= least:
                return lost + math.log(c / count[tuple(w[i - n + 1 : i])])
            lost += math.log(alpha)
        return lost + math.log(count[(w[i],)] / total)

    return [sum(log_score(w, i) for i in range(len(w))) for w in tokens]
