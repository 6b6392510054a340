"""Brute-force forms of the operators, in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return SPACED.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs, window=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        w = spaced(text)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, k=5):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, numerator=85, denominator=100):
    """{doc_id: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs}
    places = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            places[x].append(d)
    common = Counter()
    for ds in places.values():
        common.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for (a, b), c in common.items():
        if denominator * c >= numerator * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def decontaminated(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[s : s + window])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[x]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def licensed(docs):
    """{doc_id: (n_words, n_base, first_word, last_word, base_labels)}"""
    out = {}
    for doc, text in docs:
        w, at, labels = alnum(text), [], set()
        for phrase, label in PHRASES:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        out[doc] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} from {source: words}; None is last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return held | share
        held |= {s: float(most * sizes[s]) for s in over}


def colliding_words():
    """Two words that polynomials modulo 2**64 cannot tell apart: the Thue-Morse sequence of 1,024 letters, and its complement."""
    return tuple("".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024)) for flip in (0, 1))


class KneserNey:
    """Interpolated modified Kneser-Ney over characters, by its recursion."""

    def __init__(self, texts, order=4, start="￿", characters=0x110000):
        self.order, self.start, self.characters = order, start * (order - 1), characters
        self.counts = {order: Counter(p[i : i + order] for p in (self.start + t for t in texts) for i in range(len(p) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.contexts = {}, {}
        for k, c in self.counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            self.discounts[k] = [min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
            held = self.contexts[k] = defaultdict(list)
            for g, x in c.items():
                held[g[:-1]].append(x)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.characters
        below = self.p(gram[1:])
        held = self.contexts[k].get(gram[:-1])
        if not held:
            return below
        taken = lambda x: self.discounts[k][min(x, 3) - 1] if x else 0.0
        x = self.counts[k][gram]
        return (x - taken(x)) / sum(held) + sum(map(taken, held)) / sum(held) * below

    def perplexity(self, text):
        import math

        padded = self.start + text
        return math.exp(-sum(math.log(self.p(padded[i : i + self.order])) for i in range(len(text))) / len(text))
