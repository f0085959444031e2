"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def components(docs):
    sets = {}
    for i, t in docs:
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def cut_repeats(docs, window=35):
    words = {i: SPACED.findall(t or "") for i, t in docs}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    return out


def leaks(docs, bench):
    windows = defaultdict(set)
    for item, t in bench:
        w = ALNUM.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(str(item))
    out = {}
    for i, t in docs:
        w, hit, items = ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out[i] = (len(w), len(hit), sorted(items))
    return out


def licence_places(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = {}
    for i, t in docs:
        w = ALNUM.findall(lower(t))
        out[i] = (len(w), sorted((k, label) for p, label in phrases.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p))
    return out
