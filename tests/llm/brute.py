"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def repeats(docs, size=50):
    first = {}
    for i, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        for p in range(len(raw) - size + 1):
            first.setdefault(raw[p : p + size], i)
    out = {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if first[raw[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, sha(bytes(c for c, g in zip(raw, gone) if not g)))
    return out


def shingles(text, size=5):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def jaccard(docs, num=75, den=100):
    sets = {i: shingles(t) for i, t in docs}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    both = defaultdict(int)
    for ids in held.values():
        for a in range(len(ids)):
            for b in range(a):
                both[min(ids[a], ids[b]), max(ids[a], ids[b])] += 1
    u = Union()
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


def licenses(text, base):
    w = ALNUM.findall((text or "").translate(LOW))
    starts, labels = [], set()
    for phrase, label in base.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def contamination(docs, items, size=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            wins[tuple(w[k : k + size])].add(str(item))
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if got := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    text = text or ""
    found = {
        "assign": [m for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        "access": [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    spans = sorted((m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, ms) in enumerate(found.items()) for m in ms)
    return (*(len(v) for v in found.values()), sha(",".join(s[2] for s in spans)))
